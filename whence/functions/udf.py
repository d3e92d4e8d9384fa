"""UDFs whose reads can be traced, and the compact code that a call's reads are stored as."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType, _parse_datatype_string

from ..plans.rewrite import CODE_FIELD
from .taint import REGIMES, control_prov, data_prov, raw, regime, tag, taglist, trace

#: A code holds two bits of regime and two masks of parameters in a signed 64-bit integer.
MOST_PARAMETERS = 30
Reads = tuple[Sequence[str], Sequence[str], str]
#: The columns that say what UDFs read.
READS = ("_data", "_control", "_regime")


def encode(params: Sequence[str], data: set, control: set, level: str) -> int:
    n = len(params)
    if n > MOST_PARAMETERS:
        raise ValueError(f"a traced UDF takes {MOST_PARAMETERS} parameters at most")
    mask = lambda names: sum(1 << i for i, p in enumerate(params) if p in names)
    return REGIMES.index(level) | mask(data) << 2 | mask(control) << (2 + n)


def decode(code: int, params: Sequence[str]) -> Reads:
    n = len(params)
    names = lambda m: tuple(sorted(p for i, p in enumerate(params) if m >> i & 1))
    return names(code >> 2), names(code >> (2 + n)), REGIMES[code & 3]


def _field(name: str) -> str:
    """The parameter that an id belongs to: elements of a list count for the list."""
    return name.split("[")[0]


def traced_call(fn: Callable, params: Sequence[str], row: dict, traced: Callable | None = None) -> Reads:
    """What one call reads."""
    got = (traced or trace(fn))(*[taglist(row[p], f"{p}[") if isinstance(row[p], list) else tag(row[p], p) for p in params])
    return tuple(sorted({_field(x) for x in data_prov(got)})), tuple(sorted({_field(x) for x in control_prov(got)})), regime(got)


def element_reads(fn: Callable, params: Sequence[str], row: dict) -> Reads:
    """As traced_call, down to elements of lists (`scores[3]`), named by parameter and index."""
    got = trace(fn)(*[taglist(row[p], f"{p}[") if isinstance(row[p], list) else tag(row[p], p) for p in params])
    name = lambda x: x + "]" if "[" in x else x
    return tuple(sorted(map(name, data_prov(got)))), tuple(sorted(map(name, control_prov(got)))), regime(got)


def annotate(row: dict, reads: list[Reads]) -> None:
    """Adds the union of what several UDFs read, with the coarsest regime."""
    if reads:
        row["_data"] = sorted(set().union(*[r[0] for r in reads]))
        row["_control"] = sorted(set().union(*[r[1] for r in reads]))
        row["_regime"] = max((r[2] for r in reads), key=REGIMES.index)


def reads_of_code(code: Column, params: Sequence[str]) -> tuple[Column, Column, Column]:
    """The fields of a code read as data, those read as control, and the index of the regime, as expressions."""
    n = len(params)
    names = lambda first: F.array_compact(F.array(*[F.when(F.shiftright(code, first + i).bitwiseAND(F.lit(1)) == 1, F.lit(p)) for i, p in enumerate(params)]))
    return names(2), names(2 + n), code.bitwiseAND(F.lit(3)).cast("int")


def _recorder(fn: Callable, params: Sequence[str]) -> Callable:
    made: list[Callable] = []

    def call(*values: Any) -> tuple:
        if not made:
            made.append(trace(fn))
        got = made[0](*[taglist(v, f"{p}[") if isinstance(v, list) else tag(v, p) for p, v in zip(params, values, strict=True)])
        return raw(got), encode(params, {_field(x) for x in data_prov(got)}, {_field(x) for x in control_prov(got)}, regime(got))

    return call


class TracedUDF:
    """A UDF that keeps its source. While `recording`, calls also return the code of what they read."""

    def __init__(self, fn: Callable, kind: DataType | str):
        self.fn, self.kind = fn, kind  # parsed when used: workers import this without a session
        self.params = list(inspect.signature(fn).parameters)
        self.name, self.recording = fn.__name__, False
        self.code_name = f"{self.name}$"
        self.__wrapped__ = fn

    def __call__(self, *cols: Column | str) -> Column:
        if not self.recording:
            return F.udf(self.fn, self.kind)(*cols)
        kind = _parse_datatype_string(self.kind) if isinstance(self.kind, str) else self.kind
        both = StructType([StructField("v", kind), StructField(CODE_FIELD, LongType())])
        call = _recorder(self.fn, self.params)
        call.__name__ = self.code_name
        return F.udf(call, both)(*cols).getField("v")


def udf(kind: DataType | str) -> Callable[[Callable], TracedUDF]:
    """A drop-in for Spark's decorator."""
    return lambda fn: TracedUDF(fn, kind)
