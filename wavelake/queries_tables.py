"""Named queries over packet rows: scalars, sources and sinks, charts, alerts, ordered operators."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import adapters as A
from . import constants as C
from . import dims
from .functions import bytes as B
from .functions import scalars as S
from .operators import analysis, joins, ordering, stats, windows
from .plans import capture, charts
from .plans.filters import parse
from .queries import _PACKETS, _V, SQL, _packets, _r, _vectors, query
from .sources import files, sinks
from .tables import shared_folder


def _case(names: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + " END"


def _hex(x: str, n: int) -> str:
    """SQL of the hex digits of a number's n bytes, lowest first."""
    return "(" + " || ".join(f"printf('%02X', ((({x})::BIGINT) >> {8 * k}) & 255)" for k in range(n)) + ")"


# -- scalars -----------------------------------------------------------------------------------


@query("SELECT number, CASE WHEN rssi_dbfs IS NULL THEN '' ELSE printf('%.1f', rssi_dbfs + 0.001234) END AS rssi, CASE WHEN cfo_ppm IS NULL THEN '' ELSE printf('%.2f', cfo_ppm + 0.0001234) END AS cfo, printf('%.3f', timestamp_us / 1e6 + 0.00001234) AS time_s, coalesce(nullif(info, ''), pdu_name) AS info FROM packets")
def cells(spark, sf_dir):
    p = _packets(spark, sf_dir)
    return p.select("number", S.cell(F.col("rssi_dbfs") + 0.001234, 1).alias("rssi"), S.cell(F.col("cfo_ppm") + 0.0001234, 2).alias("cfo"), S.cell(F.col("timestamp_us") / 1e6 + 0.00001234, 3).alias("time_s"), S.short_info(p).alias("info"))


_M = "SELECT number, value * 10.0 ** (number % 9 - 4) + 0.0000000123 AS value, CASE WHEN number % 4 <> 0 THEN value / 1e3 + 0.00000123 END AS spread, CASE WHEN number % 3 = 0 THEN 'ppm' ELSE '' END AS units, number % 2 = 0 AS calibrated, CASE WHEN number % 5 <> 0 THEN 1.0 END AS low, CASE WHEN number % 7 <> 0 THEN 250000.0 END AS high FROM (SELECT event_id AS number, value FROM events)"


@query(
    f"SELECT number, printf('%.4g', value) || coalesce(' +/- ' || printf('%.3g', spread), '') || CASE WHEN units <> '' THEN ' ' || units ELSE '' END || CASE WHEN calibrated THEN '' ELSE '  [UNCALIBRATED]' END AS shown,"
    f" CASE WHEN low IS NULL AND high IS NULL THEN '-' ELSE trim(CASE WHEN low IS NULL THEN '-inf' ELSE '1' END || ' .. ' || CASE WHEN high IS NULL THEN '+inf' ELSE '250000' END || ' ' || units) END AS spec, CASE WHEN low IS NULL AND high IS NULL THEN NULL ELSE value >= coalesce(low, value) AND value <= coalesce(high, value) END AS in_spec FROM ({_M})",
    "",
)
def measurement_texts(spark, sf_dir):
    n, v = F.col("event_id"), F.col("value")
    m = F.struct((v * F.pow(F.lit(10.0), n % 9 - 4) + 0.0000000123).alias("value"), F.when(n % 4 != 0, v / 1e3 + 0.00000123).alias("uncertainty"), F.when(n % 3 == 0, "ppm").otherwise("").alias("units"), (n % 2 == 0).alias("calibrated"), F.when(n % 5 != 0, 1.0).alias("spec_low"), F.when(n % 7 != 0, 250000.0).alias("spec_high"))
    d = A.table(spark, sf_dir, "events").select(n.alias("number"), m.alias("m"))
    return d.select("number", S.format_measurement(F.col("m")).alias("shown"), S.spec_text(F.col("m")).alias("spec"), S.in_spec(F.col("m.value"), F.col("m.spec_low"), F.col("m.spec_high")).alias("in_spec"))


@query("SELECT event_id AS number, round(10 * log10(greatest(value / 1000, 1e-15)), 6) AS power_db, round(20 * log10(greatest(value / 1000, 1e-12)), 6) AS amplitude_db FROM events", "")
def decibels(spark, sf_dir):
    x = F.col("value") / 1000
    return A.table(spark, sf_dir, "events").select(F.col("event_id").alias("number"), F.round(S.power_db(x), 6).alias("power_db"), F.round(S.amplitude_db(x), 6).alias("amplitude_db"))


@query("SELECT c::INT AS channel, CASE c WHEN 37 THEN 2402e6 WHEN 38 THEN 2426e6 WHEN 39 THEN 2480e6 ELSE (CASE WHEN c <= 10 THEN 2404 ELSE 2406 END + 2 * c) * 1e6 END::DOUBLE AS frequency_hz, 'ch' || c || CASE WHEN c >= 37 THEN ' (adv) ' ELSE ' (data) ' END || printf('%.3f', CASE c WHEN 37 THEN 2402 WHEN 38 THEN 2426 WHEN 39 THEN 2480 ELSE CASE WHEN c <= 10 THEN 2404 ELSE 2406 END + 2 * c END::DOUBLE) || ' MHz' AS label, c >= 37 AS advertising FROM generate_series(0, 39) t(c)", "")
def channel_plans(spark, sf_dir):
    plans = [S.ChannelPlan(c, access_address=None if c >= 37 else 7) for c in range(40)]
    d = spark.createDataFrame([(p.channel, p.frequency_hz, p.label) for p in plans], "channel int, frequency_hz double, label string")
    return d.withColumn("advertising", S.is_advertising(F.col("channel")))


@query("SELECT adva, right(adva, 8) AS short, (row_number() OVER (ORDER BY min(number), adva) - 1) % 16 AS colour FROM good GROUP BY adva")
def address_colours(spark, sf_dir):
    d = windows.colours(stats.admitted(_packets(spark, sf_dir)), "adva", "number")
    return d.select("adva", S.short_address(F.col("adva")).alias("short"), F.col("colour").cast("long").alias("colour"))


@query(f"SELECT event_id AS number, {_case(dims.PDU_TYPES, 'event_id % 16')} AS pdu, {_case(dims.AD_TYPES, 'event_id % 256')} AS item, {_case(dims.COMPANIES, 'user_id % 1200')} AS maker FROM events", "")
def dimension_lookups(spark, sf_dir):
    n = F.col("event_id")
    return A.table(spark, sf_dir, "events").select(n.alias("number"), dims.lookup(dims.PDU_TYPES, (n % 16).cast("int")).alias("pdu"), dims.lookup(dims.AD_TYPES, (n % 256).cast("int")).alias("item"), dims.lookup(dims.COMPANIES, (F.col("user_id") % 1200).cast("int")).alias("maker"))


_CHANNELS = "WITH c AS (SELECT c AS channel, CASE c WHEN 37 THEN 2402e6 WHEN 38 THEN 2426e6 WHEN 39 THEN 2480e6 ELSE (CASE WHEN c <= 10 THEN 2404 ELSE 2406 END + 2 * c) * 1e6 END::DOUBLE AS hz FROM generate_series(0, 39) t(c)), e AS (SELECT event_id AS number, 2400e6 + (event_id % 85) * 1e6 + CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0 END AS hz FROM events) "


def _tuned_rows(spark, sf_dir):
    n = F.col("event_id")
    return A.table(spark, sf_dir, "events").select(n.alias("number"), (2400e6 + (n % 85) * 1e6 + F.when(n % 3 == 0, 0.5).otherwise(0.0)).alias("hz"))


@query(_CHANNELS + "SELECT e.number, c.channel FROM e LEFT JOIN c ON abs(e.hz - c.hz) < 1", "")
def nearest_channels(spark, sf_dir):
    return joins.nearest_channel(_tuned_rows(spark, sf_dir), "hz").select("number", F.col("matched_channel").cast("long").alias("channel"))


@query(_CHANNELS + "SELECT e.number, c.channel FROM e JOIN c ON abs(e.hz - c.hz) <= 4e6", "")
def channels_in_band(spark, sf_dir):
    return joins.channels_in_view(_tuned_rows(spark, sf_dir), "hz", F.lit(8e6)).select("number", F.col("seen_channel").cast("long").alias("channel"))


@query("SELECT event_id AS number, [event_id & 255, (event_id >> 8) & 255] AS bytes, list_filter(range(0, 16), lambda i: ((event_id >> i) & 1) <> ((user_id >> i) & 1)) AS wrong, printf('%02X%02X%02X', (event_id * 7919) & 255, ((event_id * 7919) >> 8) & 255, ((event_id * 7919) >> 16) & 255) AS air, (event_id * 7919) & 16777215 AS check FROM events", "")
def bits_and_checks(spark, sf_dir):
    bits = lambda c: F.array(*[F.shiftright(c, k).bitwiseAND(F.lit(1)).cast("int") for k in range(16)])
    n, u = F.col("event_id"), F.col("user_id")
    air = B.crc24_bytes((n * 7919).bitwiseAND(F.lit(0xFFFFFF)))
    longs = lambda c: c.cast("array<long>")
    return A.table(spark, sf_dir, "events").select(n.alias("number"), longs(B.bits_to_bytes(F.concat(bits(n), F.array(F.lit(1))))).alias("bytes"), longs(B.bit_differences(bits(n), bits(u))).alias("wrong"), F.hex(air).alias("air"), B.crc24_from_air(air).alias("check"))


# -- sources and sinks -------------------------------------------------------------------------


@query("SELECT number, adva, CASE WHEN adva_kind = 'public' THEN 'public' ELSE 'random' END AS tx_add, crc_ok, array_to_string(alerts, ';') AS alerts, coalesce(nullif(info, ''), pdu_name) AS info, rssi_dbfs FROM packets")
def exported_rows(spark, sf_dir):
    return sinks.export_rows(_packets(spark, sf_dir)).select("number", "adva", "tx_add", "crc_ok", "alerts", "info", "rssi_dbfs")


_SESSION = "SELECT number, adva, channel, crc_ok, rssi_dbfs FROM packets"


@query(_SESSION)
def csv_session(spark, sf_dir):
    """Exported as CSV and read back."""
    at = shared_folder(spark)
    sinks.write_csv(sinks.export_rows(_packets(spark, sf_dir)), at)
    return files.csv_sessions(spark, at).select(F.col("number").cast("long"), "adva", F.col("channel").cast("long"), "crc_ok", "rssi_dbfs")


@query(_SESSION)
def parquet_session(spark, sf_dir):
    """Exported as Parquet and read back."""
    at = shared_folder(spark)
    sinks.write_parquet(sinks.export_rows(_packets(spark, sf_dir)), at)
    return files.parquet_sessions(spark, at).select("number", "adva", F.col("channel").cast("long"), "crc_ok", "rssi_dbfs")


_FLAGS = "1 + 16 + 1024 + CASE WHEN crc_ok THEN 2048 ELSE 0 END + CASE WHEN rssi_dbfs IS NOT NULL THEN 2 ELSE 0 END"
_LEVEL = "CASE WHEN rssi_dbfs IS NULL THEN 0 ELSE greatest(-128, least(127, round_even(rssi_dbfs, 0)))::BIGINT END"
_LENGTH = "14 + octet_length(encode(info))"


@query(
    f"SELECT number, {_hex('floor(wall_time)', 4)} || {_hex('floor((wall_time - floor(wall_time)) * 1e6)', 4)} || {_hex(_LENGTH, 4)} || {_hex(_LENGTH, 4)} || {_hex('channel', 1)} || {_hex(_LEVEL, 1)} || '0000' || {_hex(str(C.ADVERTISING_ACCESS_ADDRESS), 4)} || {_hex(_FLAGS, 2)} || {_hex(str(C.ADVERTISING_ACCESS_ADDRESS), 4)} || hex(encode(info)) AS record FROM packets"
)
def capture_records(spark, sf_dir):
    p = _packets(spark, sf_dir).withColumns({"rssi_dbm": F.col("rssi_dbfs"), "noise_floor_dbfs": F.lit(None).cast("double"), "access_address": F.lit(C.ADVERTISING_ACCESS_ADDRESS).cast("long"), "raw_bytes": F.col("info").cast("binary")})
    return sinks.pcap_records(p).select("number", F.hex("record").alias("record"))


@query("SELECT 'packets ' || count(*) || ', check right ' || printf('%.1f', 100.0 * count(*) FILTER (crc_ok) / count(*)) || ' %, ' || printf('%.1f', count(*) / (max(wall_time) - min(wall_time))) || '/s, lost ' || printf('%.3f', 100.0 * 5 / 1005) || ' %' AS line FROM packets UNION ALL SELECT adva || '  ' || printf('%6d', count(*)) || '  ' || arg_min(pdu_name, number) || '  ' || arg_min(adva_kind, number) FROM good GROUP BY adva")
def console_lines(spark, sf_dir):
    text = sinks.console_report(_packets(spark, sf_dir), 5, 1000, most=1 << 20)
    return spark.createDataFrame([(line,) for line in text.splitlines()], "line string")


_HISTORY = "SELECT number AS ts, pdu_name AS source, channel, cfo_ppm AS dc_i FROM packets WHERE rssi_dbfs IS NOT NULL"


def _history(spark, sf_dir):
    return _packets(spark, sf_dir).where("rssi_dbfs is not null").select(F.col("number").cast("double").alias("ts"), F.col("pdu_name").alias("source"), "channel", F.col("cfo_ppm").alias("dc_i"))


@query(f"SELECT ts::DOUBLE AS ts, source, channel, round(dc_i, 6) AS dc_i FROM ({_HISTORY} ORDER BY ts DESC LIMIT {C.CALIBRATION_HISTORY})")
def calibration_history(spark, sf_dir):
    """A history with new rows added, written as JSON and read back: its last rows."""
    h, at = _history(spark, sf_dir), shared_folder(spark)
    os.makedirs(at.removeprefix("file://"), exist_ok=True)
    at += "/history.json"
    sinks.write_history(sinks.appended_history(h.where("ts % 2 = 0"), h.where("ts % 2 = 1")), at.removeprefix("file://"))
    return files.calibration_history(spark, at).select("ts", "source", F.col("channel").cast("long"), *_r("dc_i"))


_RECEIVER = "SELECT number, CASE WHEN number % 9 <> 0 THEN -number % 47 - 0.123 END AS peak, number % 13 = 0 AS clips, -(number % 90) - 0.37 AS dc, 1 + (number % 19 - 9) / 100.0 + 0.000123 AS gain, CASE WHEN number % 5 <> 0 THEN (number % 31 - 15) / 3.0 + 0.00123 END AS skew, calibrated, temperature_c + 0.00123 AS t, CASE WHEN number % 4 = 0 THEN 12 ELSE 0 END AS heard, (number % 100) / 100.0 + 0.00123 AS coherence FROM packets"


@query(
    f"""SELECT number, list_filter([
 CASE WHEN clips THEN CASE WHEN peak IS NULL THEN 'clips: lower the gain, amplitudes are not valid' ELSE 'clips at ' || printf('%.1f', peak) || ' dBFS: lower the gain, amplitudes are not valid' END
 WHEN peak > -10 THEN 'peak of ' || printf('%.1f', peak) || ' dBFS is high: lower the gain by about ' || printf('%.0f', peak + 12.5) || ' dB'
 WHEN peak < -30 THEN 'peak of ' || printf('%.1f', peak) || ' dBFS is low: the gain could be ' || printf('%.0f', -12.5 - peak) || ' dB higher' WHEN peak IS NOT NULL THEN 'level is good at ' || printf('%.1f', peak) || ' dBFS' END,
 CASE WHEN dc > -40 THEN 'DC of ' || printf('%.1f', dc) || ' dBFS is large, the receiver''s own correction is due' ELSE 'DC of ' || printf('%.1f', dc) || ' dBFS, taken out' END,
 CASE WHEN 100 * abs(gain - 1) > 5 THEN 'gain ratio is off by ' || printf('%.1f', 100 * abs(gain - 1)) || ' %, much' ELSE 'gain ratio is off by ' || printf('%.2f', 100 * abs(gain - 1)) || ' %, taken out' END,
 CASE WHEN skew IS NOT NULL THEN 'skew of ' || printf('%+.2f', skew) || ' degrees, taken out' END,
 CASE WHEN calibrated THEN 'clock is locked to a reference' ELSE 'clock has no reference: offsets compare within this session only' END,
 'receiver at ' || printf('%.1f', t) || ' degrees C',
 CASE WHEN heard = 0 THEN NULL WHEN coherence < 0.3 THEN 'antennas do not hear the same (coherence ' || printf('%.2f', coherence) || '): check both' WHEN coherence < 0.7 THEN 'antennas agree in part (coherence ' || printf('%.2f', coherence) || '): bearings are noisy' ELSE 'antennas agree (coherence ' || printf('%.2f', coherence) || '): subtract their phase offset' END],
 lambda x: x IS NOT NULL) AS notes, NOT clips AND NOT (heard > 0 AND coherence < 0.3) AS ok FROM (SELECT number, peak::DOUBLE AS peak, clips, dc::DOUBLE AS dc, gain::DOUBLE AS gain, skew::DOUBLE AS skew, calibrated, t::DOUBLE AS t, heard, coherence::DOUBLE AS coherence FROM ({_RECEIVER}))"""
)
def judged_receivers(spark, sf_dir):
    n = F.col("number")
    d = _packets(spark, sf_dir).select(
        "number", F.when(n % 9 != 0, -n % 47 - 0.123).alias("peak_dbfs"), (n % 13 == 0).alias("clipping"), (-(n % 90) - 0.37).alias("dc_magnitude_dbfs"), (1 + (n % 19 - 9) / 100.0 + 0.000123).alias("gain_imbalance"), F.when(n % 5 != 0, (n % 31 - 15) / 3.0 + 0.00123).alias("quadrature_skew_deg"),
        F.col("calibrated").alias("calibrated_reference"), (F.col("temperature_c") + 0.00123).alias("temperature_c"), F.when(n % 4 == 0, 12).otherwise(0).alias("antenna_packets"), ((n % 100) / 100.0 + 0.00123).alias("antenna_coherence"),
    )
    return stats.judged_calibration(d).select("number", "notes", "ok")


# -- charts and tables -------------------------------------------------------------------------


def _series_sql(value: str) -> str:
    return f", v AS (SELECT *, row_number() OVER (PARTITION BY adva ORDER BY number DESC) AS k FROM good WHERE {value} IS NOT NULL), d AS (SELECT adva FROM v GROUP BY adva ORDER BY count(*) DESC, min(number) LIMIT 8), s AS (SELECT *, CASE WHEN timestamp_us / 1e6 - lag(timestamp_us / 1e6) OVER (PARTITION BY adva ORDER BY number) > 5 THEN 1 ELSE 0 END AS leap FROM v WHERE k <= 600 AND adva IN (SELECT adva FROM d)) SELECT adva, number, round(timestamp_us / 1e6, 6) AS time_s, round({value}, 6) AS value, sum(leap) OVER (PARTITION BY adva ORDER BY number ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM s"


@query(_series_sql("cfo_ppm"))
def cfo_chart(spark, sf_dir):
    return charts.cfo_series(_packets(spark, sf_dir)).select("adva", "number", *_r("time_s", "value"), F.col("segment").cast("long"))


@query(_series_sql("rssi_dbfs"))
def rssi_chart(spark, sf_dir):
    return charts.rssi_series(_packets(spark, sf_dir)).select("adva", "number", *_r("time_s", "value"), F.col("segment").cast("long"))


@query(f"SELECT adva, number, -1 AS cluster, round(cfo_ppm, 6) AS x, round(rssi_dbfs, 6) AS y FROM packets WHERE crc_ok AND cfo_ppm IS NOT NULL AND rssi_dbfs IS NOT NULL ORDER BY number DESC LIMIT {C.SCATTER_ROWS}")
def scatter_chart(spark, sf_dir):
    return charts.scatter(_packets(spark, sf_dir), "cfo_ppm", "rssi_dbfs").select("adva", "number", "cluster", *_r("x", "y"))


_B = "b AS (SELECT adva, key, avg(value) AS m, stddev_samp(value) AS s, count(value) AS n FROM u GROUP BY adva, key HAVING count(value) >= 10)"


@query(f", {_B} SELECT x.adva, k::INT AS k, round(x.m - k * x.s, 5) AS x_low, round(x.m + k * x.s, 5) AS x_high, round(y.m - k * y.s, 5) AS y_low, round(y.m + k * y.s, 5) AS y_high FROM b x JOIN b y ON x.adva = y.adva AND x.key = 'cfo_ppm' AND y.key = 'drift_hz', generate_series(1, 2) t(k)", _V)
def baseline_boxes(spark, sf_dir):
    base = stats.baseline(windows.unpivoted(_vectors(spark, sf_dir), C.VECTOR))
    return charts.ellipses(base, "cfo_ppm", "drift_hz").select("adva", "k", *_r("x_low", "x_high", "y_low", "y_high", digits=5))


_MODES = """, v AS (SELECT adva, aoa_deg AS x, row_number() OVER (PARTITION BY adva ORDER BY aoa_deg) AS k, count(*) OVER (PARTITION BY adva) AS n FROM good WHERE aoa_deg IS NOT NULL),
 s AS (SELECT *, sum(x) OVER up AS c1, sum(x * x) OVER up AS c2, sum(x) OVER own AS t1, sum(x * x) OVER own AS t2, greatest(floor(n * 0.15), 3) AS m FROM v WINDOW up AS (PARTITION BY adva ORDER BY k ROWS UNBOUNDED PRECEDING), own AS (PARTITION BY adva)),
 c AS (SELECT *, c1 / k AS lo, (t1 - c1) / (n - k) AS hi FROM s WHERE n >= 40 AND n - m > m AND k BETWEEN m AND n - m - 1),
 z AS (SELECT *, sqrt((greatest(c2 / k - lo * lo, 0) + greatest((t2 - c2) / (n - k) - hi * hi, 0)) / 2) AS p FROM c)
 SELECT adva, round(max(CASE WHEN p > 1e-12 THEN (hi - lo) / p ELSE 0 END), 4) AS sigma FROM z GROUP BY adva HAVING max(CASE WHEN p > 1e-12 THEN (hi - lo) / p ELSE 0 END) >= 2.5"""


@query(_MODES)
def direction_splits(spark, sf_dir):
    return charts.direction(_packets(spark, sf_dir))["split"].select("adva", *_r("sigma", digits=4))


@query(f""", n AS (SELECT channel, number, round(temperature_c, 6) AS v, number // 500 AS epoch, lag(round(temperature_c, 6)) OVER w AS b, lag(number // 500) OVER w AS e FROM packets WINDOW w AS (PARTITION BY channel ORDER BY number)),
 p AS (SELECT *, unnest(CASE WHEN coalesce(e <> epoch, FALSE) THEN [0] ELSE [] END || CASE WHEN b IS NULL OR abs(v - b) > 1e-6 THEN [1] ELSE [] END) AS point FROM n),
 l AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY number DESC, point DESC) AS k FROM p),
 d AS (SELECT (floor(rssi_dbfs / 3) * 3)::DOUBLE AS bin, count(*) FILTER (crc_ok) / count(*) AS pdr FROM packets WHERE rssi_dbfs IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
 q AS (SELECT *, unnest(CASE WHEN coalesce(bin - lag(bin) OVER (ORDER BY bin) > 3, FALSE) THEN [0, 1] ELSE [1] END) AS point FROM d)
 SELECT channel::VARCHAR AS session, 'noise_floor_dbfs' AS series, number::DOUBLE AS x, CASE WHEN point = 1 THEN v END AS y FROM l WHERE k <= {C.NOISE_ROWS} UNION ALL SELECT NULL, 'pdr', CASE WHEN point = 1 THEN bin END, CASE WHEN point = 1 THEN round(pdr, 6) END FROM q""")
def noise_and_delivery(spark, sf_dir):
    p = _packets(spark, sf_dir)
    blocks = p.select(F.col("channel").cast("string").alias("session"), F.col("number").alias("block_index"), F.floor(F.col("number") / 500).alias("epoch"), F.round("temperature_c", 6).alias("noise_floor_dbfs"))
    return charts.noise_and_delivery(blocks, p).select("session", "series", "x", *_r("y"))


@query(
    f"""SELECT number::VARCHAR AS number, printf('%.0f', timestamp_us + 0.0123) AS time_us, strftime(make_timestamp((wall_time * 1e6)::BIGINT), '%H:%M:%S') AS clock, channel::VARCHAR AS channel, pdu_name AS pdu_type, adva, adva_kind AS tx_add, length::VARCHAR AS length,
 coalesce(printf('%.1f', rssi_dbfs + 0.00123), '') AS rssi, coalesce(printf('%.2f', cfo_ppm + 0.000123), '') AS cfo_ppm, '' AS mod_index, CASE WHEN crc_ok THEN 'OK' ELSE 'FAIL' END AS crc, '' AS cluster, coalesce(printf('%.2f', anomaly_score + 0.000123), '') AS anomaly, coalesce(printf('%.1f', aoa_deg), '') AS aoa_deg, '' AS phase_deg, coalesce(nullif(info, ''), pdu_name) AS info
 FROM packets ORDER BY packets.number DESC LIMIT {C.TABLE_ROWS}"""
)
def packet_list(spark, sf_dir):
    p = _packets(spark, sf_dir)
    # Away from ties, which two kinds of rounding settle differently.
    p = p.withColumns({"timestamp_us": F.col("timestamp_us") + 0.0123, "rssi_dbfs": F.col("rssi_dbfs") + 0.00123, "cfo_ppm": F.col("cfo_ppm") + 0.000123, "anomaly_score": F.col("anomaly_score") + 0.000123})
    return charts.packet_table(p)


@query("SELECT count(*) AS packets, count(*) FILTER (crc_ok) AS crc_ok, round(100.0 * count(*) FILTER (crc_ok) / count(*), 6) AS crc_percent, round(100.0 * 7 / 1007, 6) AS lost_percent FROM packets")
def status_bar(spark, sf_dir):
    return charts.status(_packets(spark, sf_dir), 7, 1000).select("packets", "crc_ok", *_r("crc_percent", "lost_percent"))


@query("""SELECT number, path, name, value, byte_start, byte_len FROM (SELECT *, unnest([
 {'path': 'Frame', 'name': 'number', 'value': number::VARCHAR, 'byte_start': NULL, 'byte_len': NULL}, {'path': 'Radio', 'name': 'channel', 'value': channel::VARCHAR, 'byte_start': NULL, 'byte_len': NULL}, {'path': 'Link', 'name': 'type', 'value': pdu_name, 'byte_start': 0, 'byte_len': 1},
 {'path': 'Link', 'name': 'length', 'value': length::VARCHAR, 'byte_start': 1, 'byte_len': 1}, {'path': 'Link', 'name': 'address', 'value': adva, 'byte_start': 2, 'byte_len': 6}, {'path': 'Link', 'name': 'address kind', 'value': adva_kind, 'byte_start': NULL, 'byte_len': NULL},
 {'path': 'Link', 'name': 'payload', 'value': lower(hex(encode(info))), 'byte_start': 2, 'byte_len': octet_length(encode(info))}, {'path': 'CRC', 'name': 'received', 'value': '0x' || printf('%06X', number), 'byte_start': NULL, 'byte_len': NULL}, {'path': 'CRC', 'name': 'right', 'value': crc_ok::VARCHAR, 'byte_start': NULL, 'byte_len': NULL}]
 || list_transform(alerts, lambda a: {'path': 'Expert', 'name': 'alert', 'value': a, 'byte_start': NULL, 'byte_len': NULL}) || [{'path': 'AD/0', 'name': 'Complete Local Name', 'value': 'A', 'byte_start': NULL, 'byte_len': 1}], recursive := true) FROM packets)""")
def packet_details(spark, sf_dir):
    item = B.parse_ad(F.unhex(F.lit("020941")))
    p = _packets(spark, sf_dir).withColumns({"payload": F.col("info").cast("binary"), "crc_received": F.col("number"), "ad_structures": item})
    return charts.detail(p).where("name not in ('time_us', 'rssi_dbfs')")


@query(f"SELECT number, adva FROM packets ORDER BY number DESC LIMIT {C.TABLE_ROWS}")
def last_rows(spark, sf_dir):
    return ordering.retained(_packets(spark, sf_dir)).select("number", "adva")


@query("SELECT number, channel FROM packets")
def detected_once(spark, sf_dir):
    """Each packet found by two overlapping blocks, once."""
    d = _packets(spark, sf_dir).select("number", F.col("channel").cast("long"), F.col("number").alias("abs_sync"))
    return ordering.once(d.unionAll(d), ["channel"]).select("number", "channel")


_FILTER = "rssi > -60 && !crc_ok or adva contains ':0'"


@query("SELECT '((rssi > -60 && !(crc_ok)) || adva contains '':0'')' AS described, count(*) AS packets FROM packets")
def filter_description(spark, sf_dir):
    from .plans.filters import filtered

    return filtered(_packets(spark, sf_dir), "  ").agg(F.lit(parse(_FILTER).describe()).alias("described"), F.count("*").alias("packets"))


# -- ordered operators -------------------------------------------------------------------------


@query("SELECT bin, coalesce(bin - lag(bin) OVER (ORDER BY bin) > 1, FALSE) AS break_before FROM (SELECT DISTINCT floor(rssi_dbfs)::DOUBLE AS bin FROM packets WHERE rssi_dbfs IS NOT NULL)")
def bin_breaks(spark, sf_dir):
    d = _packets(spark, sf_dir).where("rssi_dbfs is not null").select(F.floor("rssi_dbfs").cast("double").alias("bin")).distinct()
    return windows.bin_breaks(d, "bin", 1.0)


@query(""", c AS (SELECT channel, number AS place, round(cfo_ppm, 6) AS score FROM packets WHERE cfo_ppm > 0), i AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY place ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY channel ORDER BY place) > 6 THEN 1 ELSE 0 END AS new FROM c))
 SELECT channel, place, score FROM (SELECT *, row_number() OVER (PARTITION BY channel, island ORDER BY score DESC, place) AS k FROM i) WHERE k = 1""")
def sync_islands(spark, sf_dir):
    d = _packets(spark, sf_dir).where("cfo_ppm > 0").select(F.col("channel").cast("long"), F.col("number").alias("place"), F.round("cfo_ppm", 6).alias("score"))
    return windows.islands(d, ["channel"], "place", "score", 6)


@query(""", s AS (SELECT channel, number - 4 AS a, number + 1 + 2 AS z FROM packets WHERE cfo_ppm > 20), n AS (SELECT *, CASE WHEN a > max(z) OVER (PARTITION BY channel ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM s), g AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS span FROM n)
 SELECT channel, min(a) AS start, max(z) AS "end" FROM g GROUP BY channel, span""")
def energetic_spans(spark, sf_dir):
    d = _packets(spark, sf_dir).select(F.col("channel").cast("long"), F.col("number").alias("place"), "cfo_ppm")
    return windows.energetic_spans(d, ["channel"], "place", F.col("cfo_ppm") > 20, 4, 2)


@query(""", w AS (SELECT channel, number, sum(temperature_c) OVER f AS s, count(*) OVER f AS c FROM packets WINDOW f AS (PARTITION BY channel ORDER BY number ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
 SELECT channel, number, round(last_value(CASE WHEN c = 5 THEN s END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY number ROWS UNBOUNDED PRECEDING), 6) AS total FROM w""")
def boxcar_sums(spark, sf_dir):
    d = _packets(spark, sf_dir).select(F.col("channel").cast("long"), "number", "temperature_c")
    return windows.boxcar(d, ["channel"], "number", "temperature_c", 5).select("channel", "number", *_r("total"))


@query("SELECT place - 1 AS place, round(avg(value), 6) AS mean, label::VARCHAR AS adva FROM (SELECT label, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY label, place", "")
def mean_profiles(spark, sf_dir):
    d = A.table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("adva"), F.col("embedding").cast("array<double>").alias("profile"))
    return stats.mean_vector(d, "adva", "profile").select("adva", F.col("place").cast("long"), *_r("mean"))


_FIGURES = "SELECT number, channel, (number % 50) / 50.0 AS duty, 1e5 * (number % 41 + 1) AS bandwidth, (number % 60)::DOUBLE AS kurtosis, CASE WHEN number % 3 = 0 THEN (number % 30)::DOUBLE END AS period, CASE WHEN number % 11 = 0 THEN (number % 100)::DOUBLE END AS latency FROM packets"


@query(
    f", f AS ({_FIGURES}), s AS (SELECT *, count(*) OVER w > 8 AND stddev_pop(bandwidth) OVER w > 500000 AS swept FROM f WINDOW w AS (PARTITION BY channel ORDER BY number ROWS 239 PRECEDING)) SELECT number, CASE WHEN duty < 0.02 THEN 'benign' WHEN latency < 50 THEN 'reactive' WHEN bandwidth < 200e3 AND duty > 0.5 THEN 'cw' WHEN bandwidth > 3e6 AND kurtosis < 6 THEN 'wideband noise' WHEN period > 0.5 AND period < 20 THEN 'wifi/coexistence' WHEN swept THEN 'swept' WHEN kurtosis > 40 THEN 'chirped' ELSE 'benign' END AS classification, swept FROM s WHERE number % 16 = 0"
)
def interference_classes(spark, sf_dir):
    n = F.col("number")
    d = _packets(spark, sf_dir).select(n.alias("block_index"), "channel", ((n % 50) / 50.0).alias("duty_cycle"), (1e5 * (n % 41 + 1)).alias("occupied_bandwidth_hz"), (n % 60).cast("double").alias("spectral_kurtosis"), F.when(n % 3 == 0, (n % 30).cast("double")).alias("on_off_period_ms"), F.when(n % 11 == 0, (n % 100).cast("double")).alias("reaction_latency_us"))
    return analysis.sampled_blocks(analysis.classified(d, ["channel"])).select(F.col("block_index").alias("number"), "classification", "swept")


_COMMANDS = "steps AS (SELECT number, channel, timestamp_us AS t, CASE WHEN number % 100 = 0 THEN number % 60 END AS gain, number % 150 = 0 AS clear FROM packets WHERE number % 50 = 0)"


@query(f", {_COMMANDS}, s AS (SELECT channel, t, last_value(gain IGNORE NULLS) OVER w AS gain, sum(clear::INT) OVER w AS clears FROM steps WINDOW w AS (PARTITION BY channel ORDER BY t ROWS UNBOUNDED PRECEDING)) SELECT p.number, coalesce(s.gain, 45)::INT AS gain_db, coalesce(s.clears, 0)::BIGINT AS counter FROM packets p ASOF LEFT JOIN s ON p.channel = s.channel AND p.timestamp_us >= s.t")
def controlled_blocks(spark, sf_dir):
    p = _packets(spark, sf_dir)
    blocks = p.select(F.col("channel").alias("session"), F.col("timestamp_us").alias("wall_time"), "number", F.lit(45).alias("gain_db"))
    steps = p.where("number % 50 = 0").select(F.col("channel").alias("session"), F.col("timestamp_us").alias("effective_from"), F.when(F.col("number") % 150 == 0, "clear").when(F.col("number") % 100 == 0, "gain").otherwise("none").alias("kind"), F.when(F.col("number") % 100 == 0, F.col("number") % 60).alias("gain_db"))
    # A row that is both a clear and a gain command is two rows.
    both = steps.where("kind = 'clear' and gain_db is not null").withColumn("kind", F.lit("gain"))
    d = capture.controlled(blocks, steps.unionAll(both.withColumn("effective_from", F.col("effective_from"))))
    return d.select("number", "gain_db", "counter")


@query(", s AS (SELECT channel AS c, timestamp_us AS t, (row_number() OVER (PARTITION BY channel ORDER BY timestamp_us) - 1)::INT AS epoch, (37 + number % 3)::INT AS to_channel, 2402e6 + (number % 40) * 2e6 AS hz FROM packets WHERE number % 97 = 0) SELECT p.number, coalesce(s.to_channel, 9) AS channel, coalesce(s.hz, 1.0)::DOUBLE AS frequency_hz, coalesce(s.epoch, 0) AS epoch FROM packets p ASOF LEFT JOIN s ON p.channel = s.c AND p.timestamp_us >= s.t")
def tuned_blocks(spark, sf_dir):
    p = _packets(spark, sf_dir)
    blocks = p.select(F.col("channel").alias("session"), F.col("timestamp_us").alias("wall_time"), "number", F.lit(9).alias("channel"), F.lit(1.0).alias("frequency_hz"), F.lit(0).alias("epoch"))
    plan = p.where("number % 97 = 0").select(F.col("channel").alias("session"), F.col("timestamp_us").alias("effective_from"), (37 + F.col("number") % 3).cast("int").alias("channel"), (2402e6 + (F.col("number") % 40) * 2e6).alias("frequency_hz"))
    return capture.tuned(blocks, plan).select("number", "channel", "frequency_hz", "epoch")


# -- scores, clusters, alerts ------------------------------------------------------------------

_SCORED = ("cfo_ppm", "rssi_dbfs", "aoa_deg")


def _running(keys: tuple[str, ...]) -> str:
    """SQL of CTEs on rows `own` (adva, number, keys, temperature_c, rssi_dbfs, calibrated): z by key, and how many packets, degrees and bands there are."""
    moments = ", ".join(f"count({k}) OVER w AS n_{k}, avg({k}) OVER w AS m_{k}, stddev_samp({k}) OVER w AS s_{k}" for k in keys)
    z = ", ".join(f"CASE WHEN n_{k} >= 5 AND s_{k} > 0 AND packets >= 10{' AND calibrated' if k in C.CLOCK_BOUND else ''} THEN ({k} - m_{k}) / s_{k} END AS z_{k}" for k in keys)
    return f"""flags AS (SELECT *, (temperature_c IS NOT NULL AND row_number() OVER (PARTITION BY adva, round_even(temperature_c, 0) ORDER BY number) = 1)::INT AS d1, (rssi_dbfs IS NOT NULL AND row_number() OVER (PARTITION BY adva, floor(rssi_dbfs / 6) ORDER BY number) = 1)::INT AS b1 FROM own),
 run AS (SELECT *, count(*) OVER w AS packets, sum(d1) OVER w AS degrees, sum(b1) OVER w AS bands, {moments} FROM flags WINDOW w AS (PARTITION BY adva ORDER BY number ROWS UNBOUNDED PRECEDING)),
 z AS (SELECT *, {z} FROM run)"""


def _score(keys: tuple[str, ...]) -> str:
    total = " + ".join(f"coalesce(z_{k} * z_{k}, 0)" for k in keys)
    n = " + ".join(f"(z_{k} IS NOT NULL)::INT" for k in keys)
    return f"sqrt(({total}) / nullif({n}, 0))"


@query(f", own AS (SELECT * FROM good WHERE adva_kind = 'public'), {_running(_SCORED)} SELECT adva, number, round({_score(_SCORED)}, 5) AS anomaly_score, packets >= 30 AND degrees >= 3 AND bands >= 2 AS valid FROM z")
def running_scores(spark, sf_dir):
    own = stats.admitted(_packets(spark, sf_dir)).where("adva_kind = 'public'")
    return analysis.running_scores(own, _SCORED, needed=(30, 3, 2)).select("adva", "number", *_r("anomaly_score", digits=5), "valid")


_KEYS = ("cfo_ppm", "aoa_deg", "temperature_c")


@query(
    f""", g AS (SELECT *, row_number() OVER (PARTITION BY adva ORDER BY number) AS i FROM good), e AS (SELECT adva, number, i FROM g WHERE i >= {C.BIMODAL_AFTER} AND i % {C.BIMODAL_EVERY} = 0),
 x AS ({' UNION ALL '.join(f"SELECT adva, i, {j} AS ord, '{k}' AS key, {k} AS x FROM g WHERE {k} IS NOT NULL" for j, k in enumerate(_KEYS))}),
 h AS (SELECT * FROM (SELECT e.adva, e.number, ord, key, x, row_number() OVER (PARTITION BY e.adva, e.number, ord ORDER BY x.i DESC) AS back FROM e JOIN x ON e.adva = x.adva AND x.i <= e.i) WHERE back <= {C.BIMODAL_HISTORY}),
 c AS (SELECT *, x - avg(x) OVER own AS d, avg(x) OVER own AS middle, row_number() OVER (PARTITION BY adva, number, ord ORDER BY x) AS k, count(*) OVER own AS n FROM h WINDOW own AS (PARTITION BY adva, number, ord)),
 s AS (SELECT *, sum(d) OVER up AS c1, sum(d * d) OVER up AS c2, sum(d) OVER own AS t1, sum(d * d) OVER own AS t2, greatest(floor(n * 0.15), 3) AS m FROM c WINDOW up AS (PARTITION BY adva, number, ord ORDER BY k ROWS UNBOUNDED PRECEDING), own AS (PARTITION BY adva, number, ord)),
 p AS (SELECT *, sqrt((greatest(c2 / k - (c1 / k) ** 2, 0) + greatest((t2 - c2) / (n - k) - ((t1 - c1) / (n - k)) ** 2, 0)) / 2) AS pooled FROM s WHERE n >= {C.BIMODAL_LEAST} AND k BETWEEN m AND n - m),
 q AS (SELECT *, CASE WHEN pooled > 1e-12 THEN ((t1 - c1) / (n - k) - c1 / k) / pooled ELSE 0 END AS sigma FROM p),
 b AS (SELECT *, row_number() OVER (PARTITION BY adva, number ORDER BY sigma DESC, ord, k) AS best FROM q)
 SELECT adva, number, key, round(sigma, 4) AS sigma, round(c1 / k + middle, 4) AS low_mean, round((t1 - c1) / (n - k) + middle, 4) AS high_mean, k::BIGINT AS n_low, n::BIGINT AS n, sigma > {C.BIMODAL_SIGMA} AS alert FROM b WHERE best = 1 AND sigma > 0"""
)
def bimodal_alerts(spark, sf_dir):
    good = stats.admitted(_packets(spark, sf_dir))
    d = good.select("adva", "number", F.array(F.lit(0.0)).alias("vector"), F.array(*[F.col(k).cast("double") for k in _KEYS]).alias("values"))
    found = analysis.clustered(d, _KEYS).where("split is not null")
    return found.select("adva", "number", "split.key", *[F.round(f"split.{k}", 4).alias(k) for k in ("sigma", "low_mean", "high_mean")], F.col("split.n_low").cast("long").alias("n_low"), F.col("split.n").cast("long").alias("n"), F.col("bimodal_alert").isNotNull().alias("alert"))


def _kmeans(rows: str, width: int) -> str:
    """SQL of recursive CTEs on rows `w` (adva, i = 1, 2, ..., number, x): one step of streaming k-means a packet, and the separation after it."""
    near = f"g[j] <= {C.CLUSTER_SPLIT} OR len(c) >= {C.CLUSTERS}"
    return f"""w AS ({rows}),
 k AS (SELECT adva, i, number, [x] AS c, [1::BIGINT] AS n, [0.0::DOUBLE] AS r, 0::BIGINT AS cluster FROM w WHERE i = 1
 UNION ALL SELECT adva, i, number, CASE WHEN near THEN list_transform(c, lambda y, q: CASE WHEN q = j THEN list_transform(y, lambda v, a: v + rate * (x[a] - v)) ELSE y END) ELSE list_append(c, x) END,
 CASE WHEN near THEN list_transform(n, lambda y, q: CASE WHEN q = j THEN y + 1 ELSE y END) ELSE list_append(n, 1) END,
 CASE WHEN near THEN list_transform(r, lambda y, q: CASE WHEN q = j THEN y + rate * (g[j] * g[j] - y) ELSE y END) ELSE list_append(r, 0.0) END, CASE WHEN near THEN j - 1 ELSE len(c) END
 FROM (SELECT *, {near} AS near, greatest({C.CLUSTER_RATE}, 1 / (n[j] + 1)) AS rate FROM (SELECT *, list_position(g, list_min(g))::BIGINT AS j FROM (SELECT w.adva, w.i, w.number, w.x, k.c, k.n, k.r, list_transform(k.c, lambda y: list_distance(y, w.x) / sqrt({width})) AS g FROM k JOIN w ON k.adva = w.adva AND w.i = k.i + 1)))),
 top AS (SELECT *, list_sort(list_filter(list_transform(n, lambda y, q: {{'a': -y, 'b': q}}), lambda e: e.a <= -{C.SEPARATION_PACKETS})) AS t FROM k),
 sep AS (SELECT adva, i, number, cluster, n, CASE WHEN len(t) < 2 THEN 0 ELSE list_distance(c[t[1].b], c[t[2].b]) / sqrt({width}) / sqrt(greatest(r[t[1].b] + r[t[2].b], 1e-12)) END AS separation FROM top)"""


def _whitened(keys: tuple[str, ...], source: str) -> str:
    each = ", ".join(f"coalesce(({k} - avg({k}) OVER w) / CASE WHEN stddev_samp({k}) OVER w > 1e-12 THEN stddev_samp({k}) OVER w ELSE 1 END, 0)" for k in keys)
    return f"SELECT adva, row_number() OVER (PARTITION BY adva ORDER BY number) AS i, number, x FROM (SELECT adva, number, [{each}] AS x FROM {source} WINDOW w AS (ORDER BY number ROWS UNBOUNDED PRECEDING))"


_LABELS = "labels AS (SELECT adva, cluster, row_number() OVER (ORDER BY min(number), adva, cluster) - 1 AS label FROM sep GROUP BY adva, cluster)"


@query(f", {_kmeans(_whitened(C.VECTOR, 'v'), len(C.VECTOR))}, {_LABELS} SELECT sep.adva, number, sep.cluster, label AS cluster_id, round(separation, 5) AS separation FROM sep JOIN labels ON sep.adva = labels.adva AND sep.cluster = labels.cluster", _V.replace("WITH ", "WITH RECURSIVE ", 1))
def clustered_vectors(spark, sf_dir):
    """Vectors whitened by running moments, clustered in each address's order."""
    w = windows.whitened(_vectors(spark, sf_dir), list(C.VECTOR), "number", vector="vector").select("adva", "number", "vector")
    d = analysis.cluster_labels(analysis.clustered(w))
    return d.select("adva", "number", F.col("cluster").cast("long"), F.col("cluster_id").cast("long"), *_r("separation", digits=5))


_PAIRS = "SELECT adva, row_number() OVER (PARTITION BY adva ORDER BY number) AS i, number, [coalesce(rssi_dbfs, 0) / 10, coalesce(cfo_ppm, 0) / 10] AS x FROM good"


@query(
    f""", {_kmeans(_PAIRS, 2)}, last AS (SELECT adva, len(list_filter(arg_max(n, i), lambda y: y >= 3)) AS clusters, arg_max(separation, i) AS separation FROM sep GROUP BY adva),
 r AS (SELECT adva, avg(rssi_dbfs) AS rssi_mean, CASE WHEN count(*) > 1 THEN var_pop(rssi_dbfs) END AS rssi_variance FROM (SELECT *, row_number() OVER (PARTITION BY adva ORDER BY number DESC) AS b FROM good WHERE rssi_dbfs IS NOT NULL) WHERE b <= 256 GROUP BY adva),
 t AS (SELECT adva, median(gap) / 1000 AS interval_ms, CASE WHEN count(*) >= 4 THEN stddev_pop(gap) / 1000 END AS jitter_ms FROM gaps GROUP BY adva)
 SELECT g.adva, count(*) AS packets, round(any_value(rssi_mean), 5) AS rssi_mean, round(any_value(rssi_variance), 4) AS rssi_variance, round(any_value(interval_ms), 4) AS adv_interval_ms, round(any_value(jitter_ms), 4) AS adv_interval_jitter_ms, any_value(clusters)::BIGINT AS clusters, round(any_value(last.separation), 5) AS cluster_separation FROM good g LEFT JOIN r ON g.adva = r.adva LEFT JOIN t ON g.adva = t.adva LEFT JOIN last ON g.adva = last.adva GROUP BY g.adva""",
    _PACKETS.replace("WITH ", "WITH RECURSIVE ", 1),
)
def address_summary(spark, sf_dir):
    p = _packets(spark, sf_dir)
    vectors = stats.admitted(p).select("adva", "number", F.array(F.coalesce("rssi_dbfs", F.lit(0.0)) / 10, F.coalesce("cfo_ppm", F.lit(0.0)) / 10).alias("vector"))
    d = analysis.address_summary(p, analysis.clustered(vectors))
    return d.select("adva", "packets", *_r("rssi_mean", digits=5), *_r("rssi_variance", "adv_interval_ms", "adv_interval_jitter_ms", digits=4), "clusters", *_r("cluster_separation", digits=5))


#: A tale in which all kinds of alerts can occur: vectors as packets of three addresses, some of them enrolled.
_TALE = (
    "WITH RECURSIVE v AS (SELECT (label % 3)::VARCHAR AS adva, vec_id AS number, vec_id % 7 <> 0 AS crc_ok, vec_id * 4000.0 + 60000.0 * (vec_id // 40) AS timestamp_us, (20 + vec_id % 5)::DOUBLE AS temperature_c, (-50 - vec_id % 13)::DOUBLE AS rssi_dbfs, vec_id % 3 = 0 AS calibrated, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE + CASE WHEN label % 3 = 1 AND vec_id % 2 = 0 THEN {4 if i < 6 else 0} ELSE 0 END AS {k}" for i, k in enumerate(C.VECTOR))
    + ", [embedding[1]::DOUBLE + CASE WHEN vec_id % 101 = 0 THEN 9 ELSE 0 END, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS profile FROM embeddings), good AS (SELECT * FROM v WHERE crc_ok) "
)


def _tale(spark, sf_dir, rows=None):
    """The tale's packets, of the table or of a stream of its rows."""
    e, n = A.table(spark, sf_dir, "embeddings") if rows is None else rows, F.col("vec_id")
    one = (F.col("label") % 3 == 1) & (n % 2 == 0)
    x = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select(
        (F.col("label") % 3).cast("string").alias("adva"), n.alias("number"), F.lit(False).alias("is_event"), (n % 7 != 0).alias("crc_ok"), (n * 4000.0 + 60000.0 * F.floor(n / 40)).alias("timestamp_us"), (20 + n % 5).cast("double").alias("temperature_c"), (-50 - n % 13).cast("double").alias("rssi_dbfs"), (n % 3 == 0).alias("calibrated"),
        *[(x(i) + F.when(one, 4.0 if i < 6 else 0.0).otherwise(0.0)).alias(k) for i, k in enumerate(C.VECTOR)], F.array(x(0) + F.when(n % 101 == 0, 9.0).otherwise(0.0), x(1), x(2)).alias("profile"), F.array().cast("array<string>").alias("alerts"),
    )


def _splits(rows: str, keys: tuple[str, ...]) -> str:
    """SQL of CTEs: (adva, number, sigma) of the best split at each evaluation over rows (adva, number, keys)."""
    return f"""bg AS (SELECT *, row_number() OVER (PARTITION BY adva ORDER BY number) AS i FROM {rows}), be AS (SELECT adva, number, i FROM bg WHERE i >= {C.BIMODAL_AFTER} AND i % {C.BIMODAL_EVERY} = 0),
 bx AS ({' UNION ALL '.join(f"SELECT adva, i, '{k}' AS key, {k} AS x FROM bg WHERE {k} IS NOT NULL" for k in keys)}),
 bh AS (SELECT * FROM (SELECT be.adva, be.number, key, x, row_number() OVER (PARTITION BY be.adva, be.number, key ORDER BY bx.i DESC) AS back FROM be JOIN bx ON be.adva = bx.adva AND bx.i <= be.i) WHERE back <= {C.BIMODAL_HISTORY}),
 bc AS (SELECT *, x - avg(x) OVER own AS d, row_number() OVER (PARTITION BY adva, number, key ORDER BY x) AS k, count(*) OVER own AS n FROM bh WINDOW own AS (PARTITION BY adva, number, key)),
 bs AS (SELECT *, sum(d) OVER up AS c1, sum(d * d) OVER up AS c2, sum(d) OVER own AS t1, sum(d * d) OVER own AS t2, greatest(floor(n * 0.15), 3) AS m FROM bc WINDOW up AS (PARTITION BY adva, number, key ORDER BY k ROWS UNBOUNDED PRECEDING), own AS (PARTITION BY adva, number, key)),
 bp AS (SELECT *, sqrt((greatest(c2 / k - (c1 / k) ** 2, 0) + greatest((t2 - c2) / (n - k) - ((t1 - c1) / (n - k)) ** 2, 0)) / 2) AS pooled FROM bs WHERE n >= {C.BIMODAL_LEAST} AND k BETWEEN m AND n - m),
 best AS (SELECT adva, number, max(CASE WHEN pooled > 1e-12 THEN ((t1 - c1) / (n - k) - c1 / k) / pooled ELSE 0 END) AS sigma FROM bp GROUP BY adva, number)"""


def _profiles(rows: str) -> str:
    """SQL of recursive CTEs: `jump` (adva, number, jumps) where a delay profile leaves its usual, over rows (adva, i, number, p)."""
    return f"""pw AS ({rows}), pk AS (SELECT adva, i, number, p AS ref, []::DOUBLE[] AS d, FALSE AS jumps FROM pw WHERE i = 1
 UNION ALL SELECT adva, i, number, list_transform(ref, lambda y, q: {C.MULTIPATH_KEEP} * y + (1 - {C.MULTIPATH_KEEP}) * p[q]), d, len(d) >= {C.MULTIPATH_LEAST} AND mad > 1e-6 AND d[-1] > middle + {C.MULTIPATH_MADS} * mad
 FROM (SELECT *, 1.4826 * list_median(list_transform(d, lambda y: abs(y - middle))) AS mad FROM (SELECT *, list_median(d) AS middle FROM (SELECT pw.adva, pw.i, pw.number, pw.p, pk.ref, list_append(pk.d, list_distance(pk.ref, pw.p))[-{C.MULTIPATH_ROWS}:] AS d FROM pk JOIN pw ON pk.adva = pw.adva AND pw.i = pk.i + 1)))),
 jump AS (SELECT adva, number, jumps FROM pk)"""


_PROFILE_ROWS = "SELECT adva, row_number() OVER (PARTITION BY adva ORDER BY number) AS i, number, profile AS p FROM good"


@query(f", {_profiles(_PROFILE_ROWS)} SELECT adva, number FROM jump WHERE jumps", _TALE)
def multipath_alerts(spark, sf_dir):
    d = stats.admitted(_tale(spark, sf_dir)).select("adva", "number", F.array(F.lit(0.0)).alias("vector"), "profile")
    return analysis.clustered(d).where("multipath_alert is not null").select("adva", "number")


#: Packets, whole degrees and bands of strength that make the tale's baselines valid; and the score that alerts.
_NEEDED, _THRESHOLD = (20, 3, 2), 1.1
_KINDS = {analysis.TWO_CLUSTERS: "clusters", "has two modes": "modes", "at once": "burst", "enrolled baseline": "baseline", "delay profile": "profile"}


@query(
    f""", {_kmeans(_whitened(C.VECTOR, 'good'), len(C.VECTOR))}, {_splits('good', C.VECTOR)}, {_profiles(_PROFILE_ROWS)},
 own AS (SELECT * FROM good WHERE adva IN ('0', '1')), {_running(C.VECTOR)}, sc AS (SELECT adva, number, {_score(C.VECTOR)} AS score, packets >= {_NEEDED[0]} AND degrees >= {_NEEDED[1]} AND bands >= {_NEEDED[2]} AS valid FROM z),
 bu AS (SELECT adva, number, len(list_filter(list(timestamp_us) OVER (PARTITION BY adva ORDER BY number ROWS {C.BURST_ROWS - 1} PRECEDING), lambda t: timestamp_us - t < {C.BURST_US})) > {C.BURST_COUNT} AS burst FROM good)
 SELECT v.number, v.adva, round(sc.score, 4) AS anomaly_score, list_filter([CASE WHEN sep.separation > {C.SEPARATION_ALERT} AND sep.i >= {C.SEPARATION_AFTER} THEN 'clusters' END, CASE WHEN best.sigma > {C.BIMODAL_SIGMA} THEN 'modes' END, CASE WHEN bu.burst THEN 'burst' END, CASE WHEN sc.valid AND sc.score > {_THRESHOLD} THEN 'baseline' END, CASE WHEN jump.jumps THEN 'profile' END], lambda a: a IS NOT NULL) AS kinds
 FROM v LEFT JOIN sep ON v.adva = sep.adva AND v.number = sep.number LEFT JOIN best ON v.adva = best.adva AND v.number = best.number LEFT JOIN bu ON v.adva = bu.adva AND v.number = bu.number LEFT JOIN sc ON v.adva = sc.adva AND v.number = sc.number LEFT JOIN jump ON v.adva = jump.adva AND v.number = jump.number""",
    _TALE,
)
def alerts_in_order(spark, sf_dir):
    found = capture.analyze(_tale(spark, sf_dir), enroll=("0", "1"), threshold=_THRESHOLD, needed=_NEEDED)
    return _kinds(found).select("number", "adva", *_r("anomaly_score", digits=4), "kinds")


#: The tale told by three receivers: each has every third packet, counted by itself.
_SESSIONS = _TALE.replace("(label % 3)::VARCHAR AS adva, vec_id AS number", "(vec_id % 3)::VARCHAR || '/' || (label % 3)::VARCHAR AS adva, vec_id // 3 AS number")


@query(
    f""", {_kmeans(_whitened(C.VECTOR, 'good').replace('(ORDER BY number', "(PARTITION BY split_part(adva, '/', 1) ORDER BY number"), len(C.VECTOR))}, {_splits('good', C.VECTOR)}, {_profiles(_PROFILE_ROWS)}, {_LABELS.replace('OVER (', "OVER (PARTITION BY split_part(adva, '/', 1) ")},
 own AS (SELECT * FROM good WHERE adva LIKE '%/0' OR adva LIKE '%/1'), {_running(C.VECTOR)}, sc AS (SELECT adva, number, {_score(C.VECTOR)} AS score, packets >= {_NEEDED[0]} AND degrees >= {_NEEDED[1]} AND bands >= {_NEEDED[2]} AS valid FROM z),
 bu AS (SELECT adva, number, len(list_filter(list(timestamp_us) OVER (PARTITION BY adva ORDER BY number ROWS {C.BURST_ROWS - 1} PRECEDING), lambda t: timestamp_us - t < {C.BURST_US})) > {C.BURST_COUNT} AS burst FROM good)
 SELECT split_part(v.adva, '/', 1) AS session, v.number, split_part(v.adva, '/', 2) AS adva, coalesce(label, -1) AS cluster_id, round(sc.score, 4) AS anomaly_score, list_filter([CASE WHEN sep.separation > {C.SEPARATION_ALERT} AND sep.i >= {C.SEPARATION_AFTER} THEN 'clusters' END, CASE WHEN best.sigma > {C.BIMODAL_SIGMA} THEN 'modes' END, CASE WHEN bu.burst THEN 'burst' END, CASE WHEN sc.valid AND sc.score > {_THRESHOLD} THEN 'baseline' END, CASE WHEN jump.jumps THEN 'profile' END], lambda a: a IS NOT NULL) AS kinds
 FROM v LEFT JOIN sep ON v.adva = sep.adva AND v.number = sep.number LEFT JOIN labels ON sep.adva = labels.adva AND sep.cluster = labels.cluster LEFT JOIN best ON v.adva = best.adva AND v.number = best.number LEFT JOIN bu ON v.adva = bu.adva AND v.number = bu.number LEFT JOIN sc ON v.adva = sc.adva AND v.number = sc.number LEFT JOIN jump ON v.adva = jump.adva AND v.number = jump.number""",
    _SESSIONS,
)
def alerts_by_session(spark, sf_dir):
    """Three sessions analysed at once, each by itself: as many rows as there are packets."""
    n = F.col("number")
    d = _tale(spark, sf_dir).withColumn("session", (n % 3).cast("string")).withColumn("number", F.floor(n / 3))
    return _by_session(capture.analyze(d, enroll=("0", "1"), threshold=_THRESHOLD, needed=_NEEDED))


def _by_session(found):
    return _kinds(found).select("session", "number", "adva", F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("cluster_id"), *_r("anomaly_score", digits=4), "kinds")


@query(SQL["alerts_by_session"], "")
def streamed_alerts(spark, sf_dir):
    """As alerts_by_session, by a stream of the table's files that is run to its end and writes files."""
    from .streaming import queries as streams
    from .streaming.analysis import analysis as analysed
    from .streaming.analysis import rocksdb

    n, out = F.col("number"), shared_folder(spark)
    rows = streams.packet_stream(spark, f"{sf_dir.rstrip('/')}/embeddings.parque[t]", A.table(spark, sf_dir, "embeddings").schema)
    d = _tale(spark, sf_dir, rows).withColumn("session", (n % 3).cast("string")).withColumn("number", F.floor(n / 3))
    stream = analysed(d, enroll=("0", "1"), threshold=_THRESHOLD, needed=_NEEDED)
    with rocksdb(spark):
        run = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    return _by_session(spark.read.schema(stream.schema).parquet(f"{out}/rows"))


def _kinds(found):
    """Analysed packets with the kinds of their alerts."""

    def kind(text):
        out = F.lit("unknown")
        for part, name in _KINDS.items():
            out = F.when(text.contains(part), name).otherwise(out)
        return out

    return found.withColumn("kinds", F.transform("alerts", kind))


# -- streams -----------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, 37 + event_id % 3 AS channel, count(*) AS packets, count(*) FILTER (event_id % 7 <> 0) AS crc_ok FROM events GROUP BY 1, 2", "")
def streamed_rates(spark, sf_dir):
    """Packets by window and channel, from a stream that is run to its end: a row for each, in memory."""
    from .streaming import queries as streams

    events = A.table(spark, sf_dir, "events")
    found = streams.packet_rates(A.packets(streams.packet_stream(spark, f"{sf_dir.rstrip('/')}/events.parque[t]", events.schema)), 21_600)
    return streams.collected(found, f"rates_{abs(hash(sf_dir))}", "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("channel").cast("long"), "packets", "crc_ok")


@query(", t AS (SELECT adva, wall_time AS t, CASE WHEN wall_time - lag(wall_time) OVER (PARTITION BY adva ORDER BY wall_time) < 3600 THEN 0 ELSE 1 END AS new FROM packets), s AS (SELECT adva, t, sum(new) OVER (PARTITION BY adva ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM t) SELECT adva, (min(t) * 1e6)::BIGINT AS start_us, (max(t) * 1e6)::BIGINT + 3600000000 AS end_us, count(*) AS packets FROM s GROUP BY adva, s")
def presence(spark, sf_dir):
    from .streaming import queries as streams

    d = streams.presence(_packets(spark, sf_dir), "1 hour")
    return d.select("adva", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "packets")
