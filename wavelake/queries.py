"""Named queries over the driver's tables, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from . import constants as C
from .dims import keystream
from .functions import bytes as B
from .functions import scalars as S
from .operators import joins, ordering, stats, windows
from .plans.filters import filtered

QUERIES, SQL = {}, {}
_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.TYPES.items())
_PACKETS = f"""WITH packets AS (SELECT event_id AS number, (epoch_us(ts) - {A.ORIGIN_US}) / 10000.0::DOUBLE AS timestamp_us, epoch_us(ts) / 1000000.0::DOUBLE AS wall_time,
 37 + event_id % 3 AS channel, CASE event_type {_NAMES} ELSE 'ADV_DIRECT_IND' END AS pdu_name,
 'C0:DE:00:00:' || printf('%02X:%02X', (user_id // 256) % 256, user_id % 256) AS adva, CASE WHEN user_id % 4 = 0 THEN 'public' ELSE 'random static' END AS adva_kind,
 event_id % 32 AS length, event_id % 7 <> 0 AS crc_ok, CASE WHEN event_id % 11 <> 0 THEN -90 + value / 7 END AS rssi_dbfs,
 20 + (event_id % 90) / 10.0::DOUBLE AS temperature_c, CASE WHEN event_id % 5 <> 0 THEN (event_id % 37 - 18) * 10.0::DOUBLE END AS aoa_deg,
 CASE WHEN event_id % 13 <> 0 THEN value / 7 - event_id % 29 END AS cfo_ppm, props AS info, abs(value) / 100 AS anomaly_score, event_id % 3 = 0 AS calibrated,
 CASE WHEN event_id % 17 = 0 THEN ['burst'] WHEN event_id % 19 = 0 THEN ['drift', 'two separated feature clusters'] ELSE [] END AS alerts FROM events),
 good AS (SELECT * FROM packets WHERE crc_ok),
 gaps0 AS (SELECT adva, number, timestamp_us - lag(timestamp_us) OVER (PARTITION BY adva ORDER BY number) AS gap FROM good),
 gaps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY adva ORDER BY number DESC) AS k FROM gaps0 WHERE gap > 0 AND gap < 11000000) WHERE k <= 256)
"""


def query(sql: str | None = None, prefix: str = _PACKETS):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = prefix + sql
        return f

    return add


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.packets(A.table(spark, sf_dir, "events"))


def _r(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


@query("SELECT adva, count(*) AS packets, arg_min(pdu_name, number) AS first_pdu_name, arg_min(adva_kind, number) AS first_adva_kind FROM good GROUP BY adva")
def device_tally(spark, sf_dir):
    return stats.device_tally(_packets(spark, sf_dir))


@query("SELECT count(*) AS packets, count(*) FILTER (crc_ok) AS crc_ok, round(100.0 * count(*) FILTER (crc_ok) / count(*), 6) AS crc_percent, round(count(*) / (max(wall_time) - min(wall_time)), 9) AS packets_per_s, round(100.0 * 500 / (99500 + 500), 6) AS lost_percent FROM packets")
def session_totals(spark, sf_dir):
    d = stats.session_totals(_packets(spark, sf_dir), F.lit(500), F.lit(99_500))
    return d.select("packets", "crc_ok", *_r("crc_percent"), *_r("packets_per_s", digits=9), *_r("lost_percent"))


@query("SELECT (floor(rssi_dbfs / 3) * 3)::DOUBLE AS rssi_bin, round(count(*) FILTER (crc_ok) / count(*), 6) AS pdr, count(*) AS total FROM packets WHERE rssi_dbfs IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def pdr_vs_rssi(spark, sf_dir):
    return stats.delivery(_packets(spark, sf_dir)).select("rssi_bin", *_r("pdr"), "total")


@query("SELECT adva, round(avg(rssi_dbfs), 6) AS rssi_mean, round(CASE WHEN count(*) > 1 THEN var_pop(rssi_dbfs) END, 6) AS rssi_variance FROM (SELECT *, row_number() OVER (PARTITION BY adva ORDER BY number DESC) AS k FROM good WHERE rssi_dbfs IS NOT NULL) WHERE k <= 256 GROUP BY adva")
def rssi_stats_last256(spark, sf_dir):
    return stats.rssi_stats(_packets(spark, sf_dir)).select("adva", *_r("rssi_mean", "rssi_variance"))


@query("SELECT adva, count(*) AS gaps, round(median(gap) / 1000, 5) AS adv_interval_ms, round(CASE WHEN count(*) >= 4 THEN stddev_pop(gap) / 1000 END, 5) AS adv_interval_jitter_ms FROM gaps GROUP BY adva")
def adv_interval_stats(spark, sf_dir):
    return stats.interval_stats(_packets(spark, sf_dir)).select("adva", "gaps", *_r("adv_interval_ms", "adv_interval_jitter_ms", digits=5))


@query("SELECT adva, round(max(abs(d - k / n)), 6) AS adv_delay_uniformity FROM (SELECT *, row_number() OVER (PARTITION BY adva ORDER BY d, number) AS k FROM (SELECT adva, number, least(gap - min(gap) OVER (PARTITION BY adva), 10000000) / 10000000 AS d, count(*) OVER (PARTITION BY adva) AS n FROM (SELECT adva, number, gap FROM gaps)) WHERE n >= 20) GROUP BY adva")
def delay_uniformity(spark, sf_dir):
    return stats.delay_uniformity(_packets(spark, sf_dir), span_us=1e7).select("adva", *_r("adv_delay_uniformity"))


@query("SELECT adva, count(*) AS packets, count(DISTINCT round_even(temperature_c, 0)) AS temperatures, count(DISTINCT floor(rssi_dbfs / 6)) AS distances, (count(*) >= 20 AND count(DISTINCT round_even(temperature_c, 0)) >= 3 AND count(DISTINCT floor(rssi_dbfs / 6)) >= 2) AS valid FROM good GROUP BY adva")
def enrollment_progress(spark, sf_dir):
    return stats.enrollment(_packets(spark, sf_dir), packets_needed=20).drop("blocking")


_SPLIT = """, v AS (SELECT adva, rssi_dbfs AS x, row_number() OVER (PARTITION BY adva ORDER BY rssi_dbfs) AS k, count(*) OVER (PARTITION BY adva) AS n FROM good WHERE rssi_dbfs IS NOT NULL),
 s AS (SELECT *, sum(x) OVER up AS c1, sum(x * x) OVER up AS c2, sum(x) OVER own AS t1, sum(x * x) OVER own AS t2, greatest(floor(n * 0.15), 3) AS m FROM v WINDOW up AS (PARTITION BY adva ORDER BY x ROWS UNBOUNDED PRECEDING), own AS (PARTITION BY adva)),
 c AS (SELECT *, c1 / k AS lo, (t1 - c1) / (n - k) AS hi FROM s WHERE n >= 20 AND n - m > m AND k BETWEEN m AND n - m),
 g AS (SELECT *, sqrt((greatest(c2 / k - lo * lo, 0) + greatest((t2 - c2) / (n - k) - hi * hi, 0)) / 2) AS p FROM c),
 z AS (SELECT *, CASE WHEN p > 1e-12 THEN (hi - lo) / greatest(p, 1e-12) ELSE 0 END AS sigma FROM g),
 b AS (SELECT *, row_number() OVER (PARTITION BY adva ORDER BY sigma DESC, k) AS best FROM z)
 SELECT adva, round(sigma, 5) AS sigma, round(lo, 5) AS low_mean, round(hi, 5) AS high_mean, k AS n_low, n FROM b WHERE best = 1"""


@query(_SPLIT)
def two_mode_split(spark, sf_dir):
    d = windows.two_mode_split(stats.admitted(_packets(spark, sf_dir)), ["adva"], "rssi_dbfs")
    return d.select("adva", *_r("sigma", "low_mean", "high_mean", digits=5), F.col("n_low").cast("long"), "n")


@query("SELECT number, adva, size AS recent, size > 3 AS burst FROM (SELECT number, adva, len(list_filter(list(timestamp_us) OVER (PARTITION BY adva ORDER BY number ROWS 7 PRECEDING), lambda t: timestamp_us - t < 5000000)) AS size FROM good)")
def event_burst(spark, sf_dir):
    return windows.bursts(_packets(spark, sf_dir), within_us=5e6).select("number", "adva", F.col("recent").cast("long"), "burst")


@query("SELECT number, adva, sum(leap) OVER (PARTITION BY adva ORDER BY number ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM (SELECT *, CASE WHEN timestamp_us / 1e6 - lag(timestamp_us / 1e6) OVER (PARTITION BY adva ORDER BY number) > 5 THEN 1 ELSE 0 END AS leap FROM good)")
def gap_segments(spark, sf_dir):
    d = stats.admitted(_packets(spark, sf_dir)).withColumn("time_s", F.col("timestamp_us") / 1e6)
    return windows.gap_segments(d, ["adva"], "time_s", "number").select("number", "adva", "segment")


@query("SELECT number, adva, point, round(CASE WHEN point = 1 THEN cfo_ppm END, 6) AS cfo_ppm FROM (SELECT *, unnest(CASE WHEN timestamp_us / 1e6 - lag(timestamp_us / 1e6) OVER (PARTITION BY adva ORDER BY number) > 5 THEN [0, 1] ELSE [1] END) AS point FROM good)")
def gap_breaks(spark, sf_dir):
    d = stats.admitted(_packets(spark, sf_dir)).withColumn("time_s", F.col("timestamp_us") / 1e6)
    return windows.gap_breaks(d, ["adva"], "time_s", "number", "cfo_ppm").select("number", "adva", "point", *_r("cfo_ppm"))


@query("SELECT number, adva, round(max(rssi_dbfs + 0.35 * i) OVER (PARTITION BY adva ORDER BY number ROWS UNBOUNDED PRECEDING) - 0.35 * i, 6) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY adva ORDER BY number) AS i FROM good WHERE rssi_dbfs IS NOT NULL)")
def peak_hold(spark, sf_dir):
    d = stats.admitted(_packets(spark, sf_dir)).where("rssi_dbfs is not null")
    return windows.peak_hold(d, "adva", "number", "rssi_dbfs").select("number", "adva", *_r("peak"))


_SESSIONS = ", s AS (SELECT adva, channel, avg(rssi_dbfs) AS m, count(*) AS n FROM good WHERE rssi_dbfs IS NOT NULL GROUP BY adva, channel) "


@query(_SESSIONS + "SELECT a.adva, a.channel AS channel_a, b.channel AS channel_b, round(a.m - b.m, 6) AS difference_db, a.n AS n_a, b.n AS n_b FROM s a JOIN s b ON a.adva = b.adva AND a.channel < b.channel")
def session_join_rssi(spark, sf_dir):
    d = joins.session_join(_packets(spark, sf_dir))
    return d.select("adva", F.col("channel_a").cast("long"), F.col("channel_b").cast("long"), *_r("difference_db"), "n_a", "n_b")


@query("SELECT o.number, o.timestamp_us AS onset_us, p.timestamp_us AS preamble_us FROM (SELECT * FROM packets WHERE pdu_name = 'SCAN_REQ') o ASOF LEFT JOIN (SELECT * FROM packets WHERE pdu_name = 'ADV_NONCONN_IND') p ON o.channel = p.channel AND o.timestamp_us >= p.timestamp_us")
def reaction_latency_asof(spark, sf_dir):
    p = _packets(spark, sf_dir).select("number", "channel", "timestamp_us", "pdu_name")
    on, pre = p.where("pdu_name = 'SCAN_REQ'").drop("pdu_name"), p.where("pdu_name = 'ADV_NONCONN_IND'").select("channel", "timestamp_us", F.col("timestamp_us").alias("at"))
    return joins.as_of(on, pre, ["channel"], "timestamp_us", "at", "preamble_us").select("number", F.col("timestamp_us").alias("onset_us"), "preamble_us")


@query(", o AS (SELECT * FROM (SELECT channel, timestamp_us AS t, row_number() OVER (PARTITION BY channel ORDER BY timestamp_us DESC) AS k FROM packets WHERE pdu_name = 'SCAN_REQ') WHERE k <= 64), p AS (SELECT * FROM (SELECT channel, timestamp_us AS t, row_number() OVER (PARTITION BY channel ORDER BY timestamp_us DESC) AS k FROM packets WHERE pdu_name = 'ADV_NONCONN_IND') WHERE k <= 64) SELECT o.channel, round(median(o.t - p.t), 4) AS latency_us, count(*) AS n FROM o ASOF JOIN p ON o.channel = p.channel AND o.t >= p.t GROUP BY o.channel HAVING count(*) >= 3")
def reaction_latency(spark, sf_dir):
    p = _packets(spark, sf_dir).select("channel", F.col("timestamp_us").alias("time_us"), "pdu_name")
    d = joins.reaction_latency(p.where("pdu_name = 'SCAN_REQ'").drop("pdu_name"), p.where("pdu_name = 'ADV_NONCONN_IND'").drop("pdu_name"), ["channel"])
    return d.select(F.col("channel").cast("long"), *_r("latency_us", digits=4), "n")


@query("SELECT adva, n, round(atan2(s, c), 6) AS mean_rad, round(sqrt(s * s + c * c), 6) AS resultant, round(sqrt(-2 * ln(greatest(sqrt(s * s + c * c), 1e-9))), 6) AS spread_rad FROM (SELECT adva, avg(sin(radians(aoa_deg + 5))) AS s, avg(cos(radians(aoa_deg + 5))) AS c, count(aoa_deg) AS n FROM good GROUP BY adva) WHERE n >= 8")
def circular_bearing(spark, sf_dir):
    d = stats.circular(stats.admitted(_packets(spark, sf_dir)), F.radians(F.col("aoa_deg") + 5), ["adva"])
    return d.select("adva", "n", *_r("mean_rad", "resultant", "spread_rad"))


@query("SELECT bin, (bin * 6.0 - 90)::DOUBLE AS from_deg, n AS packets, round(0.15 + 0.8 * n / max(n) OVER (), 6) AS radius FROM (SELECT least(floor((aoa_deg + 90) / 6), 29)::INT AS bin, count(*) AS n FROM packets WHERE aoa_deg BETWEEN -90 AND 90 GROUP BY 1)")
def bearing_histogram(spark, sf_dir):
    return stats.bearing_histogram(_packets(spark, sf_dir)).select("bin", F.col("from_deg").cast("double"), "packets", *_r("radius"))


@query(", w AS (SELECT adva, greatest(-90, least(90, aoa_deg)) AS a FROM (SELECT *, row_number() OVER (PARTITION BY adva ORDER BY number DESC) AS k FROM good WHERE aoa_deg IS NOT NULL) WHERE k <= 400) SELECT adva, round(degrees(atan2(avg(sin(radians(a))), avg(cos(radians(a))))), 5) AS bearing_deg, round(stddev_pop(a), 5) AS spread_deg, count(*) AS n FROM w GROUP BY adva")
def mean_bearing(spark, sf_dir):
    return stats.mean_bearing(_packets(spark, sf_dir)).select("adva", *_r("bearing_deg", "spread_deg", digits=5), "n")


@query("SELECT number, channel, round(temperature_c, 6) AS temperature_c FROM (SELECT *, lag(temperature_c) OVER (PARTITION BY channel ORDER BY number) AS b FROM packets) WHERE b IS NULL OR abs(temperature_c - b) > 0.35")
def noise_changepoints(spark, sf_dir):
    d = windows.change_points(_packets(spark, sf_dir), ["channel"], "number", "temperature_c", least=0.35)
    return d.select("number", F.col("channel").cast("long"), *_r("temperature_c"))


_V = "WITH v AS (SELECT label::VARCHAR AS adva, vec_id AS number, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {k}" for i, k in enumerate(C.VECTOR)) + " FROM embeddings), u AS (UNPIVOT v ON " + ", ".join(C.VECTOR) + " INTO NAME key VALUE value) "


def _vectors(spark, sf_dir):
    return A.vectors(A.table(spark, sf_dir, "embeddings"), C.VECTOR)


@query("SELECT number, " + ", ".join(f"round(coalesce(({k} - avg({k}) OVER w) / CASE WHEN stddev_samp({k}) OVER w > 1e-12 THEN stddev_samp({k}) OVER w ELSE 1 END, 0), 5) AS {k}" for k in C.VECTOR[:4]) + " FROM v WINDOW w AS (ORDER BY number ROWS UNBOUNDED PRECEDING)", _V)
def running_whiten(spark, sf_dir):
    keys = list(C.VECTOR[:4])
    d = windows.whitened(_vectors(spark, sf_dir), keys, "number", block_rows=128)
    return d.select("number", *[F.round(f"{k}_w", 5).alias(k) for k in keys])


_BASE = ", b AS (SELECT adva, key, avg(value) AS m, stddev_samp(value) AS s, count(value) AS n FROM u GROUP BY adva, key), z AS (SELECT u.adva, u.number, u.key, (value - m) / s AS z FROM u JOIN b ON u.adva = b.adva AND u.key = b.key WHERE n >= 5 AND s > 0) "


@query(_BASE + "SELECT adva, number, round(sqrt(avg(z * z)), 5) AS anomaly_score FROM z GROUP BY adva, number", _V)
def anomaly_score(spark, sf_dir):
    from .operators.analysis import scored

    return scored(windows.unpivoted(_vectors(spark, sf_dir), C.VECTOR)).select("adva", "number", *_r("anomaly_score", digits=5))


@query(_BASE + "SELECT number, rank, key, round(z, 5) AS sigma FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY abs(z) DESC, key) AS rank FROM z) WHERE rank <= 3", _V)
def top3_contributions(spark, sf_dir):
    from .operators.analysis import scored

    d = scored(windows.unpivoted(_vectors(spark, sf_dir), C.VECTOR)).select("number", F.posexplode(ordering.worst()).alias("p", "e"))
    return d.select("number", (F.col("p") + 1).cast("long").alias("rank"), "e.key", F.round("e.value", 5).alias("sigma"))


@query("SELECT number, adva, key, round(value, 6) AS value FROM u", _V)
def measurement_unpivot(spark, sf_dir):
    return windows.unpivoted(_vectors(spark, sf_dir), C.VECTOR).select("number", "adva", "key", *_r("value"))


@query("SELECT adva, key, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM u GROUP BY adva, key", _V)
def baselines(spark, sf_dir):
    return stats.baseline(windows.unpivoted(_vectors(spark, sf_dir), C.VECTOR)).select("adva", "key", *_r("mean", "std"), "n")


@query(", d AS (SELECT adva FROM good WHERE rssi_dbfs IS NOT NULL GROUP BY adva ORDER BY count(*) DESC, min(number) LIMIT 8) SELECT adva, number, round(timestamp_us / 1e6, 6) AS time_s, round(rssi_dbfs, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY adva ORDER BY number DESC) AS k FROM good WHERE rssi_dbfs IS NOT NULL AND adva IN (SELECT adva FROM d)) WHERE k <= 600")
def busiest8_series(spark, sf_dir):
    return ordering.series(stats.admitted(_packets(spark, sf_dir)), "rssi_dbfs").select("adva", "number", *_r("time_s", "value"))


@query("SELECT rssi, key, n FROM (SELECT floor(kurtosis_pop(rssi_dbfs) * 1000 + 3000)::BIGINT AS rssi, channel AS key, count(*) AS n FROM packets GROUP BY channel)")
def strength_kurtosis(spark, sf_dir):
    p = _packets(spark, sf_dir)
    return stats.kurtosis(p, "rssi_dbfs", ["channel"]).join(p.groupBy("channel").count(), "channel").select(F.floor(F.col("kurtosis") * 1000).alias("rssi"), F.col("channel").cast("long").alias("key"), F.col("count").alias("n"))


@query("SELECT channel, round(quantile_cont(rssi_dbfs, 0.15), 6) AS floor FROM packets GROUP BY channel")
def noise_floor(spark, sf_dir):
    return stats.noise_floor(_packets(spark, sf_dir), F.col("rssi_dbfs"), ["channel"]).select(F.col("channel").cast("long"), *_r("floor"))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents", "")
def payload_lengths(spark, sf_dir):
    d = A.payloads(A.table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.octet_length("data").cast("long").alias("bytes"))


_TABLE = "[" + ", ".join(map(str, B._crc_table())) + "]"
_PIECES = "WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), p AS (SELECT doc_id, x, unnest(range(0, greatest(1, (len(x) + 63) // 64))) AS part FROM d), h AS (SELECT doc_id, part, x[64 * part + 1:64 * part + 64] AS h FROM p), b AS (SELECT doc_id, part, h, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::INT) AS v FROM h) "


@query(f"SELECT doc_id, part, list_reduce(v, lambda c, x: xor(c >> 8, {_TABLE}[(xor(c, x) & 255) + 1]), {B.reflect24(C.ADVERTISING_CRC_INIT)})::BIGINT AS crc FROM b", _PIECES)
def crc24(spark, sf_dir):
    """By the function that SQL calls, which takes payloads in Arrow batches; payload_checks checks the column expression."""
    from .functions.register import crc24

    d = A.pieces(A.table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("part").cast("long"), crc24("data").alias("crc"))


@query(f"SELECT event_id AS number, list_reduce(list_transform(range(0, event_id % 8), lambda i: (event_id + 31 * i) & 255), lambda c, x: xor(c >> 8, {_TABLE}[(xor(c, x) & 255) + 1]), {B.reflect24(C.ADVERTISING_CRC_INIT)})::BIGINT AS crc FROM events", "")
def payload_checks(spark, sf_dir):
    """Checks of short payloads of bytes, by the column expression."""
    n = F.col("event_id")
    values = F.when(n % 8 == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n % 8 - 1, F.lit(0))), lambda i: (n + 31 * i).bitwiseAND(F.lit(255)).cast("int")))
    return A.table(spark, sf_dir, "events").select(n.alias("number"), B.crc24(values).alias("crc"))


_LINES = "WITH d AS (SELECT doc_id, hex(encode(text)) AS x FROM documents), p AS (SELECT doc_id, x, unnest(range(0, (len(x) + 31) // 32)) AS line FROM d), h AS (SELECT doc_id, line, x[32 * line + 1:32 * line + 32] AS h FROM p), b AS (SELECT doc_id, line, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::INT) AS v FROM h) "


@query("SELECT doc_id, line, printf('%04x', line * 16) || '  ' || rpad(array_to_string(list_transform(v, lambda x: lower(lpad(hex(x), 2, '0'))), ' '), 47, ' ') || '  ' || array_to_string(list_transform(v, lambda x: CASE WHEN x >= 32 AND x < 127 THEN chr(x) ELSE '.' END), '') AS text FROM b", _LINES)
def hex_dump(spark, sf_dir):
    return B.hex_dump(A.payloads(A.table(spark, sf_dir, "documents")), "data", "doc_id").select("doc_id", F.col("line").cast("long"), "text")


@query("SELECT doc_id, part, lower(h) AS back, len(h) > 0 AS changed FROM h", _PIECES)
def whiten_roundtrip(spark, sf_dir):
    """By the function that SQL calls, which takes long payloads in Arrow batches; whitened_bytes checks the column expression."""
    from .functions.register import dewhiten

    d = A.pieces(A.table(spark, sf_dir, "documents")).withColumn("channel", F.pmod("doc_id", F.lit(40)))
    d = d.withColumn("w", dewhiten("data", "channel"))
    return d.select("doc_id", F.col("part").cast("long"), F.lower(F.hex(dewhiten("w", "channel"))).alias("back"), (F.col("w") != F.col("data")).alias("changed"))


_STREAMS = "[" + ", ".join("'" + keystream(c, B.PERIOD).hex() + "'" for c in range(40)) + "]"


@query(f"SELECT event_id AS number, array_to_string(list_transform(range(0, 8), lambda i: printf('%02x', xor((event_id + 31 * i) & 255, ('0x' || {_STREAMS}[event_id % 40 + 1][2 * i + 1:2 * i + 2])::INT))), '') AS white FROM events", "")
def whitened_bytes(spark, sf_dir):
    n = F.col("event_id")
    values = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (n + 31 * i).bitwiseAND(F.lit(255)).cast("int"))
    return A.table(spark, sf_dir, "events").select(n.alias("number"), F.lower(F.hex(B.from_bytes(B.dewhitened(values, n % 40)))).alias("white"))


_SIXES = "WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), p AS (SELECT doc_id, x, unnest(range(0, len(x) // 12)) AS part FROM d), h AS (SELECT doc_id, part, x[12 * part + 1:12 * part + 12] AS h FROM p) "


@query("SELECT doc_id, part, array_to_string([h[11:12], h[9:10], h[7:8], h[5:6], h[3:4], h[1:2]], ':') AS address, CASE WHEN doc_id % 3 = 0 THEN 'public' ELSE CASE ('0x' || h[11:12])::INT // 64 WHEN 3 THEN 'random static' WHEN 1 THEN 'resolvable private' WHEN 0 THEN 'non-resolvable private' ELSE 'random (reserved)' END END AS kind FROM h", _SIXES)
def addresses(spark, sf_dir):
    d = A.pieces(A.table(spark, sf_dir, "documents"), 6).where("octet_length(data) = 6")
    return d.select("doc_id", F.col("part").cast("long"), B.format_address(F.col("data")).alias("address"), B.address_kind(F.col("data"), F.col("doc_id") % 3 != 0).alias("kind"))


@query("SELECT number, channel, CASE channel WHEN 37 THEN 2402e6 WHEN 38 THEN 2426e6 ELSE 2480e6 END::DOUBLE AS frequency_hz, CASE WHEN number % 41 = 40 THEN NULL ELSE number % 41 END AS data_channel FROM packets")
def channel_plan_lookup(spark, sf_dir):
    c = F.col("number") % 41
    hz = F.when(c == 40, 1e9).otherwise(S.channel_to_freq(F.least(c, F.lit(39))))
    return _packets(spark, sf_dir).select("number", F.col("channel").cast("long"), S.channel_to_freq(F.col("channel")).alias("frequency_hz"), S.freq_to_channel(hz).cast("long").alias("data_channel"))


@query("SELECT number, row_class, short FROM (SELECT number, CASE WHEN list_contains(alerts, 'two separated feature clusters') THEN 'spoof' WHEN len(alerts) > 0 THEN 'alert' WHEN anomaly_score > 3 THEN 'anomaly' WHEN NOT crc_ok THEN 'crc_fail' ELSE 'plain' END AS row_class, right(adva, 8) AS short FROM packets)")
def row_class(spark, sf_dir):
    return _packets(spark, sf_dir).select("number", S.row_class().alias("row_class"), S.short_address(F.col("adva")).alias("short"))


@query("SELECT number, FALSE AS is_event, 0::BIGINT AS ordinal, '' AS event_text FROM packets UNION ALL SELECT number, TRUE, i, alerts[i] FROM packets, generate_series(1, 2) g(i) WHERE i <= len(alerts)")
def alert_union(spark, sf_dir):
    return ordering.with_events(_packets(spark, sf_dir)).select("number", "is_event", F.col("ordinal").cast("long"), F.coalesce("event_text", F.lit("")).alias("event_text"))


_BLOCKS = ", b AS (SELECT number AS block_index, channel, number * 1000 + (number % 5) * 7 AS first_sample, 1000 - number % 4 AS n_samples, number % 23 <> 0 AS valid FROM packets) "


@query(_BLOCKS + "SELECT block_index, CASE WHEN valid AND coalesce(v, FALSE) AND g > 0 THEN g ELSE 0 END AS lost FROM (SELECT *, lag(valid) OVER w AS v, first_sample - lag(first_sample + n_samples) OVER w AS g FROM b WINDOW w AS (PARTITION BY channel ORDER BY block_index))")
def loss_accounting(spark, sf_dir):
    n = F.col("number")
    b = _packets(spark, sf_dir).select(n.alias("block_index"), "channel", (n * 1000 + n % 5 * 7).alias("first_sample"), (1000 - n % 4).alias("n_samples"), (n % 23 != 0).alias("timestamp_valid"))
    return windows.lost_samples(b, ["channel"]).select("block_index", F.col("lost").cast("long"))


@query("SELECT pdu_name AS source, channel, round(arg_min(rssi_dbfs, wall_time), 6) AS first, round(arg_max(rssi_dbfs, wall_time), 6) AS last, count(rssi_dbfs) AS n, round(arg_max(rssi_dbfs, wall_time) - arg_min(rssi_dbfs, wall_time), 6) AS drift FROM packets WHERE rssi_dbfs IS NOT NULL GROUP BY pdu_name, channel HAVING count(*) >= 2")
def calibration_drift(spark, sf_dir):
    h = _packets(spark, sf_dir).select(F.col("pdu_name").alias("source"), "channel", F.col("wall_time").alias("ts"), "rssi_dbfs")
    return stats.calibration_drift(h, "rssi_dbfs").select("source", F.col("channel").cast("long"), *_r("first", "last"), "n", *_r("drift"))


@query(", e AS (SELECT (length * 3 + number % 3) AS position FROM packets WHERE NOT crc_ok), c AS (SELECT position, count(*) AS errors FROM e GROUP BY 1), t AS (SELECT max(position) AS top, count(*) AS n FROM e), d AS (SELECT g.position, coalesce(errors, 0) AS errors, top, n FROM t, generate_series(0, top) g(position) LEFT JOIN c ON c.position = g.position), s AS (SELECT sum(errors) FILTER (position >= floor((top + 1) / 2)) / max(n) AS tail FROM d) SELECT position, errors, round(errors / n, 6) AS share, CASE WHEN tail > 0.7 THEN 'late in the packet: a collision, or an emitter that reacts' WHEN tail < 0.3 THEN 'early in the packet: synchronisation or the ramp' ELSE 'all over the packet: broadband noise' END AS verdict FROM d, s")
def bit_error_profile(spark, sf_dir):
    p = _packets(spark, sf_dir).where("not crc_ok").select((F.col("length") * 3 + F.col("number") % 3).cast("int").alias("position"))
    return stats.bit_error_profile(p).select(F.col("position").cast("long"), "errors", *_r("share"), "verdict")


@query("SELECT adva, row_number() OVER (ORDER BY min(number), adva) - 1 AS label FROM good GROUP BY adva")
def first_seen_labels(spark, sf_dir):
    return windows.first_seen_labels(stats.admitted(_packets(spark, sf_dir)), ["adva"], "number").select("adva", F.col("label").cast("long"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS packets FROM events GROUP BY 1", "")
def packet_rates(spark, sf_dir):
    d = windows.rates(_packets(spark, sf_dir), F.col("event_time"), 21_600)
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), F.round(F.col("packets_per_s") * 21_600).cast("long").alias("packets"))


@query("SELECT number, a.adva, channel FROM (SELECT number, adva, channel, timestamp_us AS s, timestamp_us + 400000 AS e FROM packets WHERE pdu_name = 'SCAN_REQ') a WHERE EXISTS (SELECT 1 FROM packets b WHERE pdu_name = 'SCAN_RSP' AND b.channel = a.channel AND b.timestamp_us < a.e AND a.s < b.timestamp_us + 400000)")
def interval_overlap(spark, sf_dir):
    p = _packets(spark, sf_dir).select("number", "adva", "channel", F.col("timestamp_us").alias("start"), (F.col("timestamp_us") + 400_000).alias("end"), "pdu_name")
    a, b = p.where("pdu_name = 'SCAN_REQ'").drop("pdu_name"), p.where("pdu_name = 'SCAN_RSP'").select("channel", "start", "end")
    return joins.met(a, b, ["channel"], 100_000).select("number", "adva", F.col("channel").cast("long"))


@query()
def advertising_items(spark, sf_dir):
    """Whole texts' bytes read as advertising data: a row for each item."""
    d = A.payloads(A.table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(B.parse_ad("data")).alias("place", "item"))
    return d.select("doc_id", "place", "item.type", "item.name", "item.value", "item.truncated")


@query()
def parsed_packets(spark, sf_dir):
    """Whole texts' bytes read as packets: header, address, check."""
    d = B.parse_pdu(A.payloads(A.table(spark, sf_dir, "documents")), "data")
    return d.select("doc_id", "decoded.ok", "decoded.pdu_name", "decoded.length", "decoded.adva_str", "decoded.crc_ok", "decoded.error")


#: Filters with the SQL condition that each stands for.
FILTERS = {
    "strength": ("rssi > -60 && crc_ok", "rssi_dbfs > -60 AND crc_ok"),
    "not_equal_missing": ("rssi != -50", "rssi_dbfs IS NULL OR rssi_dbfs <> -50"),
    "negated_missing": ("!(rssi > -60)", "NOT coalesce(rssi_dbfs > -60, FALSE)"),
    "precedence": ("channel == 37 || channel == 38 and crc == fail", "channel = 37 OR (channel = 38 AND NOT crc_ok)"),
    "text": ("pdu == adv_ind and adva contains ':0'", "pdu_name = 'ADV_IND' AND contains(lower(adva), ':0')"),
    "bool_number": ("crc_ok == 1 or crc_ok != 1", "FALSE"),
    "alerts": ("alerts ~ DRIFT or anomaly >= 4.5", "contains(array_to_string(alerts, ';'), 'drift') OR anomaly_score >= 4.5"),
    "bare": ("length && calibrated", "length <> 0 AND calibrated"),
    "word_for_number": ("rssi != strong", "rssi_dbfs IS NULL"),
    "address": ("adva == c0:de:00:00:00:05", "adva = 'C0:DE:00:00:00:05'"),
}


def _filter(text):
    return lambda spark, sf_dir: filtered(_packets(spark, sf_dir), text).select("number", "adva")


for _name, (_text, _condition) in FILTERS.items():
    QUERIES[f"filter_{_name}"] = _filter(_text)
    SQL[f"filter_{_name}"] = f"{_PACKETS} SELECT number, adva FROM packets WHERE {_condition}"

from . import queries_jobs, queries_radio, queries_scans, queries_tables  # noqa: E402,F401
