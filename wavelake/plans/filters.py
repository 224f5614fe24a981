"""The display filter: a small language of conditions on packet rows, compiled to a column expression.

    expr    := all ("||" all)*            also "or"
    all     := one ("&&" one)*            also "and"
    one     := "!" one | "(" expr ")" | field [op value]      also "not"
    op      := == != > >= < <= contains ~

Precedence is not over and over or. Values are numbers, "quoted" or bare words, and addresses. The
result is two-valued: a comparison with a missing value is false, but != is true. Text compares
without regard to case and only for (in)equality; `contains` and `~` look for a piece of text. A
number field against a word that is no number is false whatever the operator; a yes/no field
understands true, yes, pass, ok and false, no, fail, and against a number it is always false.
Nothing in a filter is ever evaluated as code.

Conditions that stand at the top or under "and"/"or" are emitted bare, so that a scan can take them
over; only what is negated is made null-free first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import finite


class FilterError(ValueError):
    """A filter that cannot be read; the message says why."""


_FEATURES = {
    "cfo_ppm": "cfo_ppm", "cfo_hz": "cfo_hz", "drift_hz": "drift_hz", "drift_rate": "drift_rate", "modulation_index": "modulation_index", "mod_index": "modulation_index",
    "bt": "effective_bt", "symbol_clock_ppm": "symbol_clock_ppm", "jitter_ps": "symbol_jitter_ps", "rise_time_us": "rise_time_us", "overshoot": "overshoot",
    "delay_spread_us": "delay_spread_us", "splatter_db": "splatter_db", "eye": "eye_opening", "isi": "residual_isi", "freq_error_rms": "freq_error_rms",
    "transition_asymmetry": "transition_asymmetry", "aoa": "aoa_deg", "aoa_deg": "aoa_deg", "antenna_phase_deg": "antenna_phase_deg",
}


def _text(make):
    return "text", lambda: F.coalesce(make(), F.lit(""))


def _number(name, scale=None, kind="float"):
    return kind, lambda: finite(F.col(name)) / scale if scale else finite(F.col(name)) if kind == "float" else F.col(name)


#: Names a filter knows, with their kind and column.
FIELDS = {
    "adva": _text(lambda: F.col("adva")),
    "adva_kind": _text(lambda: F.col("adva_kind")),
    **{k: _text(lambda: F.col("pdu_name")) for k in ("pdu_type", "pdu", "type")},
    **{k: _number("length", kind="int") for k in ("length", "len")},
    **{k: _number("channel", kind="int") for k in ("channel", "chan")},
    "crc": _text(lambda: F.when(F.col("crc_ok"), "pass").otherwise("fail")),
    "crc_ok": ("bool", lambda: F.coalesce(F.col("crc_ok"), F.lit(False))),
    "info": _text(lambda: F.when(F.col("is_event"), F.col("event_text")).otherwise(F.coalesce(F.nullif(F.col("info"), F.lit("")), F.col("pdu_name")))),
    "tx_add": _text(lambda: F.when(F.col("tx_add_random"), "random").otherwise("public")),
    **{k: _number("number", kind="int") for k in ("number", "frame")},
    "time": _number("timestamp_us", 1e6),
    "payload": _text(lambda: F.lower(F.hex("payload"))),
    **{k: _number("rssi_dbfs") for k in ("rssi", "rssi_dbfs")},
    "rssi_dbm": _number("rssi_dbm"),
    "snr": _number("snr_db"),
    "gain": _number("gain_db", kind="int"),
    "temperature": _number("temperature_c"),
    "calibrated": ("bool", lambda: F.coalesce(F.col("calibrated"), F.lit(False))),
    "cluster": _number("cluster_id", kind="int"),
    "anomaly": _number("anomaly_score"),
    "alerts": _text(lambda: F.array_join("alerts", ";")),
    "event": _text(lambda: F.when(F.col("is_event"), F.col("event_kind"))),
    "antennas": _number("n_antennas", kind="int"),
    **{k: _number(v) for k, v in _FEATURES.items()},
}
_LEXEMES = (
    ("(", r"\("), (")", r"\)"), ("op", r"==|!=|>=|<=|>|<|~"), ("and", r"&&|\band\b"), ("or", r"\|\||\bor\b"), ("not", r"!|\bnot\b"), ("contains", r"\bcontains\b"),
    ("string", r"\"[^\"]*\"|'[^']*'"), ("address", r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}"), ("number", r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"), ("word", r"[A-Za-z_][A-Za-z0-9_./]*"),
)


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, place) of each lexeme."""
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        for kind, pattern in _LEXEMES:
            if m := re.compile(pattern).match(text, at):
                out.append((kind, m[0], at))
                at = m.end()
                break
        else:
            raise FilterError(f"unexpected character {text[at]!r} at position {at}")
    return out


@dataclass(frozen=True)
class Filter:
    """A node of a filter: all / any / none of its parts, or a condition on a field."""

    kind: str  # any, all, none, is, compare
    parts: tuple = ()
    field: str = ""
    op: str = ""
    value: float | str | None = None
    shown: str = ""

    def describe(self) -> str:
        if self.kind == "is":
            return self.field
        if self.kind == "compare":
            return f"{self.field} {self.op} {self.shown}"
        if self.kind == "none":
            return f"!({self.parts[0].describe()})"
        return "(" + (" || " if self.kind == "any" else " && ").join(p.describe() for p in self.parts) + ")"

    def column(self) -> Column:
        if self.kind == "none":
            return ~F.coalesce(self.parts[0].column(), F.lit(False))
        if self.kind in ("any", "all"):
            out = self.parts[0].column()
            for p in self.parts[1:]:
                out = out | p.column() if self.kind == "any" else out & p.column()
            return out
        kind, make = FIELDS[self.field]
        value = make()
        if self.kind == "is":
            return value if kind == "bool" else value != "" if kind == "text" else value != 0
        return _compared(kind, value, self.op, self.value)


def _python_text(kind: str, value: Column) -> Column:
    return F.lower(value.cast("string"))


def _compared(kind: str, value: Column, op: str, literal: float | str) -> Column:
    if op in ("contains", "~"):
        return _python_text(kind, value).contains(str(literal).lower())
    if kind == "bool":
        word = str(literal).strip().lower()
        meant = True if word in ("true", "yes", "1", "pass", "ok") else False if word in ("false", "no", "0", "fail") else None
        if meant is None or op not in ("==", "!="):
            return F.lit(False)
        return value if meant == (op == "==") else ~value
    if kind == "text":
        if op not in ("==", "!="):
            return F.lit(False)
        want = F.lit(str(literal).upper())
        return F.upper(value) == want if op == "==" else F.upper(value) != want
    try:
        number = F.lit(float(literal))
    except ValueError:
        # A missing value differs from any word; a number and a word that is none are incomparable.
        return value.isNull() if op == "!=" and kind == "float" else F.lit(False)
    if op == "!=":
        return value.isNull() | (value != number)
    return {"==": value.__eq__, ">": value.__gt__, ">=": value.__ge__, "<": value.__lt__, "<=": value.__le__}[op](number)


class _Reader:
    def __init__(self, text: str):
        self.rest = tokens(text)[::-1]

    def next_is(self, *kinds: str) -> bool:
        return bool(self.rest) and self.rest[-1][0] in kinds

    def take(self) -> tuple[str, str, int]:
        if not self.rest:
            raise FilterError("unexpected end of expression")
        return self.rest.pop()

    def chain(self, join: str, kind: str, part) -> Filter:
        parts = [part()]
        while self.next_is(join):
            self.take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else Filter(kind, tuple(parts))

    def expr(self) -> Filter:
        return self.chain("or", "any", lambda: self.chain("and", "all", self.one))

    def one(self) -> Filter:
        kind, text, _ = self.take()
        if kind == "not":
            return Filter("none", (self.one(),))
        if kind == "(":
            inner = self.expr()
            if not self.next_is(")"):
                raise FilterError("unbalanced parenthesis")
            self.take()
            return inner
        if kind != "word":
            raise FilterError(f"expected a field name, got {text!r}")
        field = text.lower()
        if field not in FIELDS:
            raise FilterError(f"unknown field {text!r}; some are: {', '.join(sorted(FIELDS)[:12])}, ...")
        if not self.rest or self.next_is("and", "or", ")"):
            return Filter("is", field=field)
        op_kind, op, _ = self.take()
        if op_kind not in ("op", "contains"):
            raise FilterError(f"expected an operator after {text!r}")
        value_kind, value, _ = self.take()
        if op_kind == "op" and value_kind not in ("number", "word", "string", "address"):
            raise FilterError(f"expected a value after {op!r}")
        literal = float(value) if value_kind == "number" else value[1:-1] if value_kind == "string" else value
        return Filter("compare", field=field, op=op, value=literal, shown=value)


def parse(text: str) -> Filter:
    reader = _Reader(text)
    found = reader.expr()
    if reader.rest:
        _, text, at = reader.rest[-1]
        raise FilterError(f"unexpected {text!r} at position {at}")
    return found


def compile_filter(text: str | None) -> Column | None:
    """The condition that a filter's text stands for; None for an empty one (no filtering)."""
    if text is None or not text.strip():
        return None
    return parse(text).column()


def filtered(packets, text: str | None):
    """Packets that a filter lets through, in a batch or a stream."""
    condition = compile_filter(text)
    return packets if condition is None else packets.where(condition)
