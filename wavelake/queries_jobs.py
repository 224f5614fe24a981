"""The jobs as queries: each run twice into a new shared folder, and its output read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import constants as C
from .functions import bytes as B
from .queries import _PACKETS, _TABLE, query
from .tables import shared_folder


@query(
    """, s AS (SELECT CAST(make_timestamp((wall_time * 1e6)::BIGINT) AS DATE) AS day, adva, channel, avg(rssi_dbfs) AS mean, count(*) AS n FROM good WHERE rssi_dbfs IS NOT NULL AND rssi_dbfs > -85 GROUP BY 1, 2, 3)
 SELECT day::VARCHAR AS day, a.adva, a.channel AS channel_a, b.channel AS channel_b, round(round(a.mean, 6) - round(b.mean, 6), 6) AS difference_db, a.n AS n_a, b.n AS n_b FROM s a JOIN s b USING (day, adva) WHERE a.channel < b.channel""",
    _PACKETS,
)
def job1_session_days(spark, sf_dir):
    """Differences of strength between channels, by day and address."""
    from jobs import session_days

    config = {"events": f"{sf_dir.rstrip('/')}/events.parquet", "out": f"{shared_folder(spark)}/session_days", "filter": "crc == pass && rssi > -85"}
    session_days.run(spark, config)
    d = session_days.run(spark, config)
    return d.select(F.col("day").cast("string"), "adva", *[F.col(c).cast("long") for c in ("channel_a", "channel_b")], "difference_db", "n_a", "n_b")


@query(
    f"""WITH t AS (SELECT coalesce(text, '') AS t, count(*) AS transmissions, count(DISTINCT coalesce(source, '')) AS transmitters, min(doc_id) AS first_doc_id, arg_min(coalesce(source, ''), doc_id) AS first_source FROM documents GROUP BY 1)
 SELECT sha256(t) AS digest, list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::INT), lambda c, x: xor(c >> 8, {_TABLE}[(xor(c, x) & 255) + 1]), {B.reflect24(C.ADVERTISING_CRC_INIT)})::BIGINT AS crc, octet_length(encode(t)) AS n_bytes, transmissions, transmitters, first_doc_id, first_source, transmitters > 1 AS shared FROM t""",
    "",
)
def job2_payload_register(spark, sf_dir):
    """Payloads by digest, and who has sent them; the texts come as a file stream."""
    from jobs import payload_register

    # As a pattern, so that a single file is as good as a folder of files.
    config = {"texts": f"{sf_dir.rstrip('/')}/documents.parque[t]", "out": f"{shared_folder(spark)}/payload_register"}
    payload_register.run(spark, config)
    return payload_register.run(spark, config).drop("bucket")
