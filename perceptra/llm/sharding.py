"""Sharding over fixed virtual slots with a versioned slot-to-shard map: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize

SHARDS, SLOTS = 16, 4096
#: A slot heavier than a whole shard's share is cut by text into parts of this share of a shard; a text heavier than a part is cut by key.
PART = 1 / 8
#: Rows numbered by one window.
NUMBERED = 2000
#: The text of a unit that holds many texts.
MANY = -1
UNIT = ["vslot", "hot_text", "part"]


def hash60(x: Column) -> Column:
    """60 bits of an MD5: the same in every run and engine."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Narrow rows: key, size (UTF-8 bytes and one), checksum, hash of the text, virtual slot (by the text, so that equal texts go together), hash of the key."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), hash60(body).alias("_text"))
    deal = hash60(F.concat_ws("/", F.coalesce(F.col("_key").cast("string"), F.lit("")), "text_crc32", "size"))
    return materialize(rows.withColumns({"vslot": F.pmod("_text", F.lit(slots)).cast("int"), "_deal": deal}), "measured")


def find_cuts(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows (vslot, hot_text, parts) of the slots that outweigh a shard, fewer than there are shards, and of the texts in them that outweigh a part, fewer than shards / PART."""
    slots = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"))
    mean = slots.agg((F.sum("bytes") / shards).alias("mean"))
    heavy = slots.crossJoin(F.broadcast(mean)).where("bytes > mean").select("vslot", "bytes", (F.col("mean") * PART).alias("_part"))
    heavy = materialize(heavy, "heavy")
    texts = rows.join(F.broadcast(heavy.select("vslot", "_part")), "vslot").groupBy("vslot", "_text", "_part").agg(F.sum("size").alias("bytes")).where("bytes > _part")
    parts = F.ceil(F.col("bytes") / F.col("_part")).cast("int").alias("parts")
    return materialize(heavy.select("vslot", F.lit(MANY).cast("long").alias("hot_text"), parts).unionAll(texts.select("vslot", F.col("_text").alias("hot_text"), parts)), "cuts")


def place_units(rows: DataFrame, cuts: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds hot_text and part: a cut slot's rows by their text, those of a hot text by their key, others whole. cuts is bounded (find_cuts)."""
    by_key = cuts.where(F.col("hot_text") != MANY).select("vslot", F.col("hot_text").alias("_text"), F.col("parts").alias("_keys"))
    by_text = cuts.where(F.col("hot_text") == MANY).select("vslot", F.col("parts").alias("_texts"))
    rows = rows.join(F.broadcast(by_text), "vslot", "left").join(F.broadcast(by_key), ["vslot", "_text"], "left")
    hot = F.col("_keys").isNotNull()
    part = F.when(hot, F.pmod("_deal", F.col("_keys"))).otherwise(F.pmod(F.floor(F.col("_text") / slots), F.coalesce("_texts", F.lit(1)))).cast("int")
    return rows.withColumns({"hot_text": F.when(hot, F.col("_text")).otherwise(F.lit(MANY).cast("long")), "part": part}).drop("_texts", "_keys")


def weigh(placed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows (vslot, hot_text, part, parts, bytes, n): a bounded table, a row for each unit."""
    units = placed.groupBy(*UNIT).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    units = units.join(F.broadcast(cuts), ["vslot", "hot_text"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return materialize(units.select(*UNIT, "parts", "bytes", "n"), "units")


def build_map(weights: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """Rows (version, vslot, hot_text, part, parts, bytes, shard): the heaviest unit first, each to the shard with the fewest bytes so far.

    weights has a row for each unit: a bounded table, folded in one row.
    """
    unit = F.struct("bytes", "vslot", "hot_text", "part", "parts")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("out"))

    def place(state, x):
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        loads = F.transform(state["loads"], lambda load, i: load + F.when(i == at, x["bytes"]).otherwise(0))
        return F.struct(loads.alias("loads"), F.concat(state["out"], F.array(at)).alias("out"))

    units = weights.agg(F.sort_array(F.collect_list(unit), asc=False).alias("units"))
    placed = units.select(F.explode(F.arrays_zip("units", F.aggregate("units", start, place)["out"].alias("shard"))).alias("x"))
    return placed.select(F.lit(version).alias("version"), *(F.col(f"x.units.{c}") for c in [*UNIT, "parts", "bytes"]), "x.shard")


def rebalance(slot_map: DataFrame, weights: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The next version of the map: units keep their shard but for moves from the fullest shard to the emptiest that bring both nearer the mean.

    Where shards are added, units move only into these. weights has the current bytes of each unit; both tables are bounded by
    the number of units, so the edits are planned on the driver.
    """
    now = {(r.vslot, r.hot_text, r.part): (r.parts, r.bytes) for r in weights.collect()}
    rows = slot_map.collect()
    version = max((r.version for r in rows), default=0)
    old = {(r.vslot, r.hot_text, r.part): r for r in rows if r.version == version}
    home = {unit: r.shard for unit, r in old.items()}
    parts = {unit: r.parts for unit, r in old.items()} | {unit: p for unit, (p, _) in now.items()}
    size = {unit: now[unit][1] if unit in now else 0 for unit in parts}
    loads = [0] * shards
    for unit, n in sorted(size.items(), key=lambda x: (-x[1], x[0])):
        if home.get(unit, shards) >= shards:
            home[unit] = loads.index(min(loads))
        loads[home[unit]] += n
    mean = sum(loads) / shards
    takers = sorted(set(range(shards)) - {r.shard for r in old.values()}) or range(shards)
    for _ in range(2 * len(home)):
        full, low = loads.index(max(loads)), min(takers, key=loads.__getitem__)
        gap = loads[full] - loads[low]
        fits = [(abs(gap / 2 - size[u]), u) for u, s in home.items() if s == full and 0 < size[u] < gap]
        if loads[full] <= mean * (1 + tolerance) and loads[low] >= mean * (1 - tolerance) or not fits:
            break
        unit = min(fits)[1]
        home[unit] = low
        loads[full] -= size[unit]
        loads[low] += size[unit]
    edited = [(version + 1, *unit, parts[unit], size[unit], shard) for unit, shard in sorted(home.items())]
    return slot_map.sparkSession.createDataFrame(edited, "version int, vslot int, hot_text long, part int, parts int, bytes long, shard int")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds the map's versions to the store at path; a version that is there already is an error, since others may have used it."""
    session = slot_map.sparkSession
    where = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).exists(where):
        known = {r.version for r in session.read.parquet(path).select("version").distinct().collect()}
        if twice := known & {r.version for r in slot_map.select("version").distinct().collect()}:
            raise ValueError(f"{path} has version {min(twice)}")
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map at path, the latest if none is named."""
    store = spark.read.parquet(path)
    if version is None:
        version = store.agg(F.max("version")).first()[0]
    found = store.where(F.col("version") == version)
    return found.select(F.col("version").cast("int").alias("version"), *UNIT, "parts", "bytes", "shard")


def map_documents(rows: DataFrame, slot_map: DataFrame | None = None, shards: int = SHARDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their unit, units with bytes and rows, map): a first map, or the given one's next version if the units or the shards ask for it."""
    if slot_map is None:
        cuts = find_cuts(rows, shards)
    else:
        cuts = materialize(slot_map.where((F.col("parts") > 1) | (F.col("hot_text") != MANY)).select("vslot", "hot_text", "parts").distinct(), "cuts")
    placed = place_units(rows, cuts)
    units = weigh(placed, cuts)
    if slot_map is None:
        return placed, units, materialize(build_map(units.drop("n"), shards), "shard-map")
    known = slot_map.where(F.col("shard") < shards)
    if units.join(F.broadcast(known), UNIT, "left_anti").isEmpty() and known.agg(F.max("shard")).first()[0] == shards - 1:
        return placed, units, slot_map
    return placed, units, materialize(rebalance(slot_map, units, shards), "shard-map")


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, slot_map: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Rows (key, size, text_crc32, law, shard, slot, grown_shard, vslot, part) for every row of docs; the law is "bytes".

    Records are hashed into thousands of virtual slots, bytes are summed by slot, and a map gives each slot a shard. Without slot_map a first
    version is made; with one (load_map) it is used, and edited (rebalance) where it lacks a unit or a shard; path keeps the version that was used. Equal
    texts share a slot. A slot that outweighs a shard is cut by text, a text that outweighs a part by key, nothing else. Null text has size
    1; null and repeated keys are rows like others; an empty table gives an empty result; other columns are ignored. slot numbers the rows
    of a shard from 0: each unit's rows are numbered apart, in runs, and shifted by the counts of the runs before, so no task sorts a shard.
    """
    rows = measure(docs, key, text)
    placed, units, used = map_documents(rows, slot_map, shards)
    if path and (slot_map is None or used is not slot_map):
        save_map(used, path)
    where = units.join(used.select(*UNIT, "shard"), UNIT).select(*UNIT, "shard", F.ceil(F.col("n") / NUMBERED).alias("_runs"))
    placed = placed.join(F.broadcast(where), UNIT)
    run = F.shiftright(F.shiftright("_deal", 30) * F.col("_runs"), 30).cast("int")
    placed = materialize(placed.withColumn("_run", run).drop("_runs", "_text"), "placed")
    drop_table(rows)
    runs = placed.groupBy("shard", *UNIT, "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy(*UNIT, "_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*UNIT, "_run", "_start")
    own = Window.partitionBy(*UNIT, "_run").orderBy("_deal", F.col("_key").isNull(), "_key", "text_crc32", "size")
    numbered = placed.withColumn("_own", F.row_number().over(own) - 1).join(starts, [*UNIT, "_run"])
    slot = (F.col("_start") + F.col("_own")).cast("long").alias("slot")
    return numbered.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"), "vslot", "part")
