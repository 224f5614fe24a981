"""python -m wavelake: sessions joined by address, captures decoded and reported, packets filtered and exported."""

from __future__ import annotations

import argparse
import json
import sys

from . import constants as C


def parser() -> argparse.ArgumentParser:
    number = lambda text: int(text, 0)
    p = argparse.ArgumentParser(prog="wavelake", description=__doc__)
    channel = p.add_argument_group("channel")
    channel.add_argument("--channel", type=int)
    channel.add_argument("--freq", type=float)
    channel.add_argument("--access-address", type=number)
    channel.add_argument("--crc-init", type=number)
    capture = p.add_argument_group("capture")
    capture.add_argument("--blocks", help="sample blocks as Parquet")
    capture.add_argument("--sample-rate", type=float, default=8e6)
    capture.add_argument("--block-size", type=int, default=16_384)
    capture.add_argument("--rssi-cal", type=float)
    capture.add_argument("--no-spectra", action="store_true", help="leave the spectral measurements out")
    analysis = p.add_argument_group("analysis")
    analysis.add_argument("--enroll", action="append", default=[], metavar="ADDRESS")
    analysis.add_argument("--filter", default="")
    mode = p.add_argument_group("mode")
    mode.add_argument("--packets", help="packet rows as Parquet, instead of blocks")
    mode.add_argument("--join", nargs="+", metavar="FILE", help="sessions to join by address")
    mode.add_argument("--out", help="where packets go, as <out>.parquet, <out>.csv, <out>.pcap and <out>.json")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .dsp.demod import Receiver
    from .functions.scalars import ChannelPlan
    from .operators.joins import WARNING, session_report
    from .plans.capture import analyze, numbered, packet_rows
    from .plans.filters import filtered
    from .sources import files, sinks
    from .tables import held

    plan = ChannelPlan(args.channel, args.freq, args.access_address, args.crc_init)
    spark = SparkSession.builder.appName("wavelake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.join:
        for line in session_report(files.session_files(spark, args.join)).toJSON().toLocalIterator():
            print(line)
        print(WARNING, file=sys.stderr)
        return 0
    if args.blocks:
        receiver = Receiver(args.sample_rate, plan.channel, plan.access_address)
        packets = held(packet_rows(files.sample_blocks(spark, args.blocks), receiver, not args.no_spectra, args.rssi_cal, block_samples=args.block_size))
        packets = held(analyze(numbered(packets), tuple(args.enroll)))
    elif args.packets:
        packets = files.parquet_sessions(spark, args.packets)
    else:
        parser().error("one of --blocks, --packets and --join is needed")
    shown = filtered(packets, args.filter)
    print(sinks.console_report(shown))
    if args.out:
        rows = sinks.export_rows(packets, shown)
        sinks.write_parquet(rows, args.out + ".parquet")
        sinks.write_csv(rows, args.out + ".csv")
        n = sinks.write_pcap(shown, args.out + ".pcap") if "raw_bytes" in shown.columns else 0
        sinks.write_manifest(args.out + ".json", vars(args) | {"plan": plan.label, "thresholds": {"anomaly": C.ANOMALY_ALERT}}, {"captured": n})
        print(json.dumps({"written": args.out}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
