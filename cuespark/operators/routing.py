"""Routes between languages, voices for languages, and which scripts convert into which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K


def leg_table(spark: SparkSession) -> DataFrame:
    """The fixed catalog of direct legs: a few dozen rows at most."""
    return spark.createDataFrame(K.LEGS, "source string, target string, model string, prefix string")


def translation_routes(pairs: DataFrame, legs: DataFrame, pivot: str = K.PIVOT_LANGUAGE) -> DataFrame:
    """Add `legs` (array of "a-b") or `error` to every (source, target).

    The direct leg if there is one, else two legs through the pivot language unless one side is
    the pivot itself. A missing leg is an error that names it.
    """
    d = legs.select("source", "target", F.lit(True).alias("_direct"))
    a = legs.where(F.col("target") == pivot).select("source", F.lit(True).alias("_in"))
    b = legs.where(F.col("source") == pivot).select("target", F.lit(True).alias("_out"))
    p = pairs.join(d, ["source", "target"], "left").join(a, "source", "left").join(b, "target", "left")
    one = F.col("_direct").isNotNull() | (F.col("source") == pivot) | (F.col("target") == pivot)
    leg = lambda x, y: F.concat(x, F.lit("-"), y)
    route = F.when(one, F.array(leg("source", "target"))).otherwise(
        F.array(leg("source", F.lit(pivot)), leg(F.lit(pivot), "target")))
    gone = F.when(one & F.col("_direct").isNull(), F.struct(F.col("source").alias("s"), F.col("target").alias("t"))).when(
        ~one & F.col("_in").isNull(), F.struct(F.col("source").alias("s"), F.lit(pivot).alias("t"))).when(
        ~one & F.col("_out").isNull(), F.struct(F.lit(pivot).alias("s"), F.col("target").alias("t")))
    error = F.concat(F.lit("no model from '"), gone["s"], F.lit("' to '"), gone["t"], F.lit("'"))
    return p.select(*pairs.columns, F.when(error.isNull(), route).alias("legs"), error.alias("error"))


def models_for(routes: DataFrame, legs: DataFrame) -> DataFrame:
    """Models a route needs, each once, in route order: (source, target, position, model)."""
    r = routes.where("error is null").select("source", "target", F.posexplode("legs").alias("at", "leg"))
    m = legs.select(F.concat("source", F.lit("-"), "target").alias("leg"), "model")
    r = r.join(m, "leg").groupBy("source", "target", "model").agg(F.min("at").alias("at"))
    w = Window.partitionBy("source", "target").orderBy("at")          # two rows at most
    return r.select("source", "target", (F.row_number().over(w) - 1).alias("position"), "model")


def pick_engine(pairs: DataFrame, legs: DataFrame, routed: str = "routed", direct: str = "direct") -> DataFrame:
    """Add `engine`: the explicit choice, else the routed engine where all its legs exist, else the
    one that translates every pair directly. Some languages always go to the latter."""
    r = translation_routes(pairs, legs)
    forced = F.col("source").isin(K.DIRECT_SOURCES) | F.col("target").isin(K.DIRECT_TARGETS)
    auto = F.when(forced | F.col("error").isNotNull(), direct).otherwise(routed)
    choice = F.col("choice") if "choice" in pairs.columns else F.lit("auto")
    return r.select(*pairs.columns, F.when(choice != "auto", choice).otherwise(auto).alias("engine"))


def script_for_language(language) -> Column:
    c = F.col(language) if isinstance(language, str) else language
    return F.when(c.isin(K.LATIN_SCRIPT_LANGUAGES), "roman").when(c.isin(K.SCRIPT_CODES), c).otherwise("")


def pair_supported(engine, source, target) -> Column:
    """Whether an engine ("rule" or "neural") converts between two scripts."""
    e, s, t = F.col(engine), F.col(source), F.col(target)
    return (s != t) & F.when(e == "rule", s.isin(K.SCRIPT_CODES) & t.isin(K.SCRIPT_CODES)).when(
        e == "neural", model_key(source, target).isNotNull()).otherwise(False)


def model_key(source, target) -> Column:
    """Key of the neural model that serves a script pair, or null."""
    s, t = F.col(source), F.col(target)
    key = F.when(s.isin(K.NEURAL_HINDI_SOURCES) & (t == "ur"), "hi-ur")
    for a, b in K.NEURAL_SCRIPT_PAIRS:
        key = F.when((s == a) & (t == b), f"{a}-{b}").otherwise(key)
    return key


def resolve_voice(requests: DataFrame, voices: DataFrame, engines: list[tuple[str, bool]]) -> DataFrame:
    """Add the voice that speaks a request, with a warning or an error.

    requests  (request_id, language, engine, voice, can_clone), voice "auto" or a voice id
    voices    (engine, voice_id, language, grade, preferred, ord): the catalog, one row per voice
    engines   (name, clones) in order of preference

    The requested engine wins if it speaks the language, and has something to clone if it clones.
    Else the first stock engine that speaks it; never another cloning engine.
    """
    spark = requests.sparkSession
    order = spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(engines)], "engine string, clones boolean, eo int")
    grade = F.array_position(F.array(*[F.lit(g) for g in K.GRADES]), F.coalesce("grade", F.lit("unrated")))
    w = Window.partitionBy("engine", "language").orderBy(F.col("preferred").desc(), grade, "ord")
    best = voices.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("engine", "language", F.col("voice_id").alias("best"))
    able = best.join(order, "engine")
    per_lang = able.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("eo", "engine", "clones", "best"))).alias("able"))
    r = requests.join(per_lang, "language", "left").join(F.broadcast(order.select(
        F.col("engine"), F.col("clones").alias("_clones"))), "engine", "left")
    able_ = F.coalesce("able", F.array().cast("array<struct<eo:int,engine:string,clones:boolean,best:string>>"))
    r = r.withColumn("_speaks", F.exists(able_, lambda a: a["engine"] == F.col("engine")))
    own = F.col("_speaks") & (~F.col("_clones") | F.col("can_clone"))
    pick = F.when(own, F.get(F.filter(able_, lambda a: a["engine"] == F.col("engine")), F.lit(0))).otherwise(
        F.get(F.filter(able_, lambda a: ~a["clones"]), F.lit(0)))
    r = r.withColumn("_p", pick)
    named = voices.select(F.col("engine").alias("_ve"), F.col("voice_id").alias("voice"), F.col("language").alias("_vl"))
    r = r.join(named, (r["voice"] == named["voice"]) & (r["engine"] == named["_ve"]), "left").drop(named["voice"])
    by_name = own & (F.col("voice") != "auto") & ~F.col("_clones")
    cloner = F.get(F.filter(able_, lambda a: a["clones"]), F.lit(0))["engine"]
    error = (F.when(F.col("_p").isNull() & F.col("_speaks"), F.concat("engine", F.lit(" needs a recording to clone: no stock voice speaks '"), "language", F.lit("'.")))
             .when(F.col("_p").isNull() & cloner.isNotNull(), F.concat("engine", F.lit(" can't speak '"), "language", F.lit("'; choose voice cloning ("), cloner, F.lit(").")))
             .when(F.col("_p").isNull(), F.concat(F.lit("No voice speaks '"), "language", F.lit("'.")))
             .when(by_name & F.col("_vl").isNull(), F.concat(F.lit("Unknown "), "engine", F.lit(" voice: "), "voice", F.lit(".")))
             .when(by_name & (F.col("_vl") != F.col("language")), F.concat(F.lit("The voice "), "voice", F.lit(" speaks '"), "_vl", F.lit("', not '"), "language", F.lit("'."))))
    reason = F.when(F.col("_clones") & F.col("_speaks"), "has no original voice to clone").otherwise(
        F.concat(F.lit("can't speak '"), "language", F.lit("'")))
    ok = error.isNull()
    return r.select(
        *requests.columns, F.when(ok, F.col("_p.engine")).alias("used_engine"),
        F.when(ok, F.when(by_name, F.col("voice")).otherwise(F.col("_p.best"))).alias("used_voice"),
        F.when(ok & (F.col("_p.engine") != F.col("engine")), F.concat(
            "engine", F.lit(" "), reason, F.lit(", so "), F.col("_p.engine"), F.lit(" was used instead."))).alias("warning"),
        error.alias("error"))
