"""The label space: predicates with their components, families and confusions, objects and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The 132 predicate names.
PREDICATES = """
above away behind beneath bite chase creep_above creep_away creep_behind creep_beneath creep_front creep_left creep_next_to creep_past
creep_right creep_toward drive fall_off faster feed fight fly_above fly_away fly_behind fly_front fly_left fly_next_to fly_past fly_right
fly_toward fly_with follow front hold jump_above jump_away jump_behind jump_beneath jump_front jump_left jump_next_to jump_past jump_right
jump_toward jump_with kick larger left lie_above lie_behind lie_beneath lie_front lie_inside lie_left lie_next_to lie_right lie_with
move_above move_away move_behind move_beneath move_front move_left move_next_to move_past move_right move_toward move_with next_to past play
pull ride right run_above run_away run_behind run_beneath run_front run_left run_next_to run_past run_right run_toward run_with sit_above
sit_behind sit_beneath sit_front sit_inside sit_left sit_next_to sit_right stand_above stand_behind stand_beneath stand_front stand_inside
stand_left stand_next_to stand_right stand_with stop_above stop_behind stop_beneath stop_front stop_left stop_next_to stop_right stop_with
swim_behind swim_beneath swim_front swim_left swim_next_to swim_right swim_with taller touch toward walk_above walk_away walk_behind
walk_beneath walk_front walk_left walk_next_to walk_past walk_right walk_toward walk_with watch
""".split()

#: The 35 object names.
OBJECTS = """
turtle antelope bicycle lion ball motorcycle cattle airplane red_panda horse watercraft monkey fox elephant bird sheep frisbee giant_panda
squirrel bus bear tiger train snake rabbit whale sofa skateboard dog domestic_cat person lizard hamster car zebra
""".split()

#: Everyday names of objects.
ALIASES = {"human": "person", "man": "person", "woman": "person", "bike": "bicycle", "cat": "domestic_cat", "motorbike": "motorcycle", "plane": "airplane", "boat": "watercraft", "cow": "cattle", "couch": "sofa", "panda": "giant_panda"}

#: The families' actions and spatial words, the confusion groups, the neighbours.
FAMILY_ACTIONS = {
    "geometry": "",
    "relative_motion": "chase follow",
    "locomotion_state": "creep fly jump lie move run sit stand stop swim walk",
    "contact": "bite fight kick play touch",
    "manipulation": "drive fall_off feed hold pull ride",
    "attention_social": "chase fight follow play watch",
    "comparative": "",
}
FAMILY_SPATIALS = {"geometry": "above behind beneath front inside left next_to right", "relative_motion": "away past toward with"}
CONFUSION_GROUPS = {
    "contact_kind": "touch bite kick",
    "contact_control": "touch hold pull feed",
    "social_contact": "fight play touch",
    "pursuit": "follow chase watch",
    "vehicle_control": "ride drive",
    "motion_direction": "toward away past",
    "locomotion": "creep move walk run",
    "posture": "sit stand lie stop",
    "depth": "front behind",
}
FAMILY_NEIGHBORS = {
    "geometry": "relative_motion comparative",
    "relative_motion": "geometry locomotion_state attention_social",
    "locomotion_state": "relative_motion attention_social",
    "contact": "manipulation attention_social",
    "manipulation": "contact relative_motion",
    "attention_social": "contact relative_motion locomotion_state",
    "comparative": "geometry relative_motion",
}
#: Inverses used for coupling, and predicates that exclude each other.
INVERSES = {"left": "right", "right": "left", "above": "beneath", "beneath": "above", "front": "behind", "behind": "front", "away": "toward", "toward": "away"}
MUTEX = (("left", "right"), ("above", "beneath"), ("behind", "front"), ("away", "toward"))
#: Comparatives, relations that geometry decides without a model, relations that hold both ways, and what the families mean.
COMPARATIVES = ("faster", "larger", "taller")
SYMMETRIC = ("next_to", "touch", "fight", "play", "with")
FAMILY_DESCRIPTIONS = {
    "geometry": "relative position, containment, and depth",
    "relative_motion": "approaching, separating, passing, following, or moving together",
    "locomotion_state": "the subject's movement or posture while related to the object",
    "contact": "visible physical contact or impact",
    "manipulation": "the subject controls, carries, operates, or transfers the object",
    "attention_social": "attention or sustained social interaction",
    "comparative": "relative size, height, or speed",
}
GEOMETRIC = ("left", "right", "above", "beneath", "next_to")

ACTIONS = {a for text in FAMILY_ACTIONS.values() for a in text.split()}
SPATIALS = {x for text in FAMILY_SPATIALS.values() for x in text.split()}


def components(name: str) -> tuple[str, str, str]:
    """(action, spatial, comparative): atomic names have one of them, others split at the first underscore; unknown names are actions."""
    if name in COMPARATIVES:
        return "", "", name
    if name in SPATIALS:
        return "", name, ""
    head, _, tail = name.partition("_")
    return (head, tail, "") if name not in ACTIONS and head in ACTIONS and tail in SPATIALS else (name, "", "")


def predicates(spark: SparkSession) -> DataFrame:
    """id, name, action, spatial, comparative."""
    return spark.createDataFrame([(i, n, *components(n)) for i, n in enumerate(PREDICATES)], "id int, name string, action string, spatial string, comparative string")


def objects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in OBJECTS], "name string")


def aliases(spark: SparkSession) -> DataFrame:
    """alias (spaced form), name; every object is an alias of itself."""
    rows = [(n.replace("_", " "), n) for n in OBJECTS] + list(ALIASES.items())
    return spark.createDataFrame(rows, "alias string, name string")


def _words(spark: SparkSession, table: dict[str, str], key: str, value: str) -> DataFrame:
    rows = [(i, k, j, w) for i, (k, text) in enumerate(table.items()) for j, w in enumerate(text.split())]
    return spark.createDataFrame(rows, f"group_ord int, {key} string, ord int, {value} string")


def family_members(spark: SparkSession) -> DataFrame:
    """name, family: a predicate is in each family that has its action, spatial word or comparative; if in none, in attention_social."""
    p = predicates(spark)
    by_action = p.join(F.broadcast(_words(spark, FAMILY_ACTIONS, "family", "action")), "action").select("name", "family")
    by_spatial = p.join(F.broadcast(_words(spark, FAMILY_SPATIALS, "family", "spatial")), "spatial").select("name", "family")
    compared = p.where("comparative <> ''").select("name", F.lit("comparative").alias("family"))
    found = by_action.unionByName(by_spatial).unionByName(compared).distinct()
    rest = p.join(found, "name", "left_anti").select("name", F.lit("attention_social").alias("family"))
    return found.unionByName(rest)


def neighbors(spark: SparkSession) -> DataFrame:
    return _words(spark, FAMILY_NEIGHBORS, "family", "neighbor").select("family", "neighbor", "ord")


def siblings(spark: SparkSession) -> DataFrame:
    """name, sibling, ord: predicates that are easily taken for each other, in the groups' order, each once.

    Within a group: its literal names, then predicates that differ in the action alone, then those that differ in the spatial word alone.
    """
    p, g = predicates(spark), _words(spark, CONFUSION_GROUPS, "grp", "word")
    own, other = g.select("group_ord", F.col("word").alias("mine")), g.select("group_ord", F.col("word").alias("theirs"), "ord")
    pairs = own.join(other, "group_ord").where("mine <> theirs")
    literal = pairs.select(F.col("mine").alias("name"), F.col("theirs").alias("sibling"), "group_ord", F.lit(0).alias("branch"), F.col("ord").alias("at"))
    literal = literal.join(p.select("name"), "name", "left_semi")
    q = p.select(F.col("id").alias("at"), F.col("name").alias("sibling"), F.col("action").alias("qa"), F.col("spatial").alias("qs"))

    def differing(part: str, theirs: str, same: str, q_same: str, branch: int) -> DataFrame:
        hit = p.where(F.col(part) != "").join(F.broadcast(pairs), F.col(part) == F.col("mine"))
        hit = hit.join(F.broadcast(q), (F.col(theirs) == F.col("theirs")) & (F.col(same) == F.col(q_same)))
        return hit.select("name", "sibling", "group_ord", F.lit(branch).alias("branch"), "at")

    found = literal.unionByName(differing("action", "qa", "spatial", "qs", 1)).unionByName(differing("spatial", "qs", "action", "qa", 2))
    first = found.groupBy("name", "sibling").agg(F.min(F.struct("group_ord", "branch", "at")).alias("o"))
    return first.select("name", "sibling", (F.row_number().over(Window.partitionBy("name").orderBy("o", "sibling")) - 1).alias("ord"))


def families(spark: SparkSession) -> DataFrame:
    """family, description."""
    return spark.createDataFrame(list(FAMILY_DESCRIPTIONS.items()), "family string, description string")


def candidates_for(pairs: DataFrame) -> DataFrame:
    """``pairs`` with every predicate as a candidate: classes suppress none, evidence decides."""
    return pairs.withColumn("candidates", F.array(*map(F.lit, PREDICATES)))


def summary(spark: SparkSession) -> DataFrame:
    """name, parts, symmetric: the components of each predicate as text, ``atomic`` where there are none."""
    part = lambda c: F.when(F.col(c) != "", F.concat(F.lit(f"{c}="), F.col(c)))
    text = F.concat_ws(", ", part("action"), part("spatial"), part("comparative"))
    return predicates(spark).select("name", F.when(text == "", "atomic").otherwise(text).alias("parts"), F.col("name").isin(*SYMMETRIC).alias("symmetric"))


def inverses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(INVERSES.items()), "predicate string, inverse string")


def mutex(spark: SparkSession) -> DataFrame:
    """p, q: each excluding pair once, p before q by name."""
    return spark.createDataFrame(list(MUTEX), "p string, q string")


def values_sql(name: str, columns: str, rows) -> str:
    """A DuckDB common table expression of literal rows."""
    lit = lambda v: str(v) if isinstance(v, int | float) else "'" + v + "'"
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


def predicates_sql() -> str:
    return values_sql("predicates", "id, name, action, spatial, comparative", [(i, n, *components(n)) for i, n in enumerate(PREDICATES)])


def words_sql(name: str, table: dict[str, str]) -> str:
    return values_sql(name, "group_ord, grp, ord, word", [(i, k, j, w) for i, (k, text) in enumerate(table.items()) for j, w in enumerate(text.split())])
