"""Raw frames to signals: payload words, bit fields, byte order, sources and their catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from drivespan.functions.draws import draw

TX = 0x80


def own_bus(src: Column) -> Column:
    return src.bitwiseAND(F.lit(0x7F))


def frames_of(df: DataFrame, address: int, bus: int, include_tx: bool = False) -> DataFrame:
    """Frames of one address and bus, without those that the device itself sent. The address predicate reaches a Parquet scan."""
    out = df.filter((F.col("address") == address) & (own_bus(F.col("src")) == bus))
    return out if include_tx else out.filter(F.col("src").bitwiseAND(F.lit(TX)) == 0)


def payload_halves(payload: Column, order: str = "big") -> tuple[Column, Column]:
    """The high and the low 32 bits of an 8-byte payload; shorter payloads are padded with zeros on the right before the order is applied."""
    text = F.rpad(F.hex(payload), 16, "0")
    if order == "little":
        text = F.concat(*(F.substring(text, 15 - 2 * i, 2) for i in range(8)))
    half = lambda a: F.conv(F.substring(text, a, 8), 16, 10).cast("long")
    return half(1), half(9)


def bit_field(high: Column, low: Column, start: int, length: int, signed: bool) -> Column:
    """A field of up to 32 bits whose first (most significant) bit is number `start` counted from the word's top bit, as a long."""
    end = start + length
    if end <= 32:
        raw = F.shiftrightunsigned(high, 32 - end)
    elif start >= 32:
        raw = F.shiftrightunsigned(low, 64 - end)
    else:
        raw = F.shiftleft(high, end - 32).bitwiseOR(F.shiftrightunsigned(low, 64 - end))
    raw = raw.bitwiseAND(F.lit((1 << length) - 1))
    return F.when(raw >= (1 << (length - 1)), raw - (1 << length)).otherwise(raw) if signed else raw


def motorola_start(byte: int, bit: int) -> int:
    """The position from the word's top of bit `bit` (7 the highest) of byte `byte`."""
    return byte * 8 + (7 - bit)


def decode(df: DataFrame, specs: list[dict], order: str = "big", keys: tuple[str, ...] = ("drive", "t")) -> DataFrame:
    """Long table (keys, channel, v) of all signals: specs hold channel, address, bus, start, length, signed, factor, offset and scale.

    Frames meet the specs in one broadcast join on (address, bus); only signals of the frame's own address are computed.
    """
    high, low = payload_halves(F.col("payload"), order)
    rows = df.filter(F.col("src").bitwiseAND(F.lit(TX)) == 0).withColumns({"__h": high, "__l": low, "__bus": own_bus(F.col("src"))})
    cells = [
        F.when(
            (F.col("address") == s["address"]) & (F.col("__bus") == s["bus"]),
            F.struct(F.lit(s["channel"]).alias("channel"), ((bit_field(F.col("__h"), F.col("__l"), s["start"], s["length"], s.get("signed", False)) * F.lit(float(s.get("factor", 1.0))) + F.lit(float(s.get("offset", 0.0)))) * F.lit(float(s.get("scale", 1.0)))).alias("v")),
        )
        for s in specs
    ]
    wanted = F.col("address").isin([s["address"] for s in specs])
    return rows.filter(wanted).select(*keys, F.inline(F.array_compact(F.array(*cells))))


def absent(df: DataFrame, specs: list[dict]) -> DataFrame:
    """Channels whose address and bus no frame has."""
    table = df.sparkSession.createDataFrame([(s["channel"], s["address"], s["bus"]) for s in specs], "channel string, address long, bus long")
    seen = df.select(F.col("address").cast("long").alias("address"), own_bus(F.col("src")).cast("long").alias("bus")).distinct()
    return table.join(seen, ["address", "bus"], "left_anti").select("channel")


def byte_order(df: DataFrame, key: str, start: int, length: int, factor: float, low: float, high: float) -> DataFrame:
    """(key, byte_order, score): the order whose decoded values are plausible more often and spread less; score = plausible share - spread / range."""
    parts = []
    for order in ("big", "little"):
        h, l = payload_halves(F.col("payload"), order)
        parts.append(df.select(key, F.lit(order).alias("byte_order"), (bit_field(h, l, start, length, False) * factor).alias("x")))
    both = parts[0].unionByName(parts[1])
    score = F.avg(F.col("x").between(low, high).cast("double")) - (F.percentile("x", 0.75) - F.percentile("x", 0.25)) / (high - low)
    per = both.groupBy(key, "byte_order").agg(score.alias("score"))
    return per.groupBy(key).agg(F.max_by("byte_order", F.struct("score", F.when(F.col("byte_order") == "big", 1).otherwise(0))).alias("byte_order"), F.max("score").alias("score"))


def combined(long: DataFrame, keys: list[str], parts: list[str], out: str, how: str = "mean") -> DataFrame:
    """A channel from several with equal times: their sum or mean where all are there."""
    one = [F.max(F.when(F.col("channel") == p, F.col("v"))) for p in parts]
    total = sum(one[1:], one[0])
    return long.filter(F.col("channel").isin(parts)).groupBy(*keys).agg((total / len(parts) if how == "mean" else total).alias("v")).filter("v is not null").withColumn("channel", F.lit(out))


def signed_axes(long: DataFrame, signs: DataFrame, on_missing: str = "drop") -> DataFrame:
    """Acceleration channels times their vehicle's sign (vehicle, channel, sign); a channel whose sign is unknown is dropped, or kept as it is with on_missing="keep"."""
    axes = F.col("channel").startswith("accel_")
    met = long.join(F.broadcast(signs), ["vehicle", "channel"], "left")
    v = F.when(axes & F.col("sign").isNotNull(), F.col("v") * F.col("sign")).otherwise(F.col("v"))
    keep = ~axes | F.col("sign").isNotNull() if on_missing == "drop" else F.lit(True)
    return met.filter(keep).withColumn("v", v).drop("sign")


def match_profiles(drives: DataFrame, profiles: DataFrame) -> DataFrame:
    """drives with their profile by dongle, else by platform; status is ok or skipped:unknown_vehicle."""
    by_dongle = profiles.filter("dongle is not null").select("dongle", F.col("profile").alias("p1"))
    by_platform = profiles.filter("platform is not null").select("platform", F.col("profile").alias("p2"))
    met = drives.join(F.broadcast(by_dongle), "dongle", "left").join(F.broadcast(by_platform), "platform", "left").withColumn("profile", F.coalesce("p1", "p2"))
    return met.withColumn("status", F.when(F.col("profile").isNull(), "skipped:unknown_vehicle").otherwise("ok")).drop("p1", "p2")


def work_list(segments: DataFrame, drive: str, index: str, routes: int, per_route: int) -> DataFrame:
    """The first `routes` drives by name, and of each the first per_route indices of its longest consecutive run."""
    from drivespan.operators.islands import longest_run

    run = longest_run(segments, drive, index)
    picked = run.orderBy(drive).limit(routes)
    met = segments.join(picked, drive).filter((F.col(index) >= F.col("first")) & (F.col(index) < F.col("first") + per_route) & (F.col(index) <= F.col("last")))
    return met.select(drive, index).distinct()


def stratified(df: DataFrame, strata: list[str], key: str, share: float, seed: int) -> DataFrame:
    """About `share` of each stratum, at least one row, by the hash of (seed, key): the same rows every time."""
    w = Window.partitionBy(*strata)
    rank = F.row_number().over(w.orderBy(draw(seed, F.col(key)), key))
    return df.withColumn("__r", rank).withColumn("__n", F.count(F.lit(1)).over(w)).filter(F.col("__r") <= F.greatest(F.lit(1), F.ceil(F.col("__n") * share))).drop("__r", "__n")


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that the sink doesn't hold yet."""
    return work.join(done, keys, "left_anti")


def weather_long(df: DataFrame, key: list[str], quantities: list[str], t: str, fmt: list[str], sentinel: float = -998.0) -> DataFrame:
    """Wide weather rows of strings to (key, t, quantity, value): values at or below the sentinel are null; the first of the formats that a time fits counts."""
    ts = F.coalesce(*(F.try_to_timestamp(F.col(t), F.lit(f)) for f in fmt))
    parts = ", ".join(f"'{q}', try_cast(`{q}` as double)" for q in quantities)
    long = df.select(*key, ts.alias("t"), F.expr(f"stack({len(quantities)}, {parts}) as (quantity, raw)"))
    return long.select(*key, "t", "quantity", F.when(F.col("raw") > sentinel, F.col("raw")).alias("value"))


def config_hash(*configs: dict) -> str:
    """Twelve hex digits of the configuration, for every output row."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(configs, sort_keys=True, default=str).encode()).hexdigest()[:12]
