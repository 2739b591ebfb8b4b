"""Row schemas and coded values of a trace.

Unsigned 64-bit ids, times and counters are `long`; addresses may exceed 2^63 and stay
`decimal(20,0)` so comparisons remain unsigned.
"""

from __future__ import annotations

from pyspark.sql import types as T

ADDRESS = T.DecimalType(20, 0)
_L, _I, _S, _B = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


def _endpoint(prefix: str) -> list[tuple[str, T.DataType]]:
    names = [("Symoff", _L), ("Sym", _S), ("SymStart", ADDRESS), ("SymEnd", ADDRESS), ("Dso", _S),
             ("SymBinding", _I), ("Is64Bit", _I), ("IsKernelIp", _I), ("BuildId", _B),
             ("Filtered", _I), ("Comm", _S)]
    return [(prefix + name, kind) for name, kind in names]


TRACE_SAMPLE = _struct(
    ("id", _L), ("perfId", _L), ("pid", _L), ("tid", _L), ("time", _L), ("cpu", _L), ("flags", _L),
    ("ip", ADDRESS), ("ipLocationId", _L), ("addr", ADDRESS), ("addressLocationId", _L),
    ("period", _L), ("insnCnt", _L), ("cycCnt", _L), ("weight", _L), ("cpumode", _I),
    ("addrCorrelatesSym", _I), ("event", _S), ("machinePid", _L), ("vcpu", _L),
    ("srcFileName", _S), ("srcLineNumber", _L),
    *_endpoint("ip"), ("haveAddress", T.BooleanType()), *_endpoint("address"),
)

SOURCE_LOCATION = _struct(
    ("id", _L), ("buildId", _B), ("dso", _S), ("relativeAddress", ADDRESS), ("symbol", _S),
    ("symbolOffset", _L), ("symbolStart", ADDRESS), ("symbolEnd", ADDRESS),
    ("sourceFileName", _S), ("sourceLineNumber", _L), ("sourceColumnNumber", _L),
    ("inlineDepth", _L), ("keyStrength", _I), ("isKernelIp", _I),
)

AUX_LOSS = _struct(("id", _L), ("time", _L), ("pid", _L), ("tid", _L), ("cpu", _L), ("flags", _L))

STACK_FRAME = _struct(
    ("frameId", _L), ("tid", _L), ("depth", _L), ("startTime", _L), ("endTime", _L),
    ("startTrace", _L), ("endTrace", _L), ("locationId", _L), ("startCpu", _L), ("endCpu", _L),
    ("startReason", _I), ("endReason", _I), ("kind", _I),
)

STACK_RANGE = _struct(("startTrace", _L), ("endTrace", _L))

STACK_INDEX = _struct(
    ("pid", _L), ("tid", _L), ("cpu", _L), ("depth", _L), ("startTime", _L), ("endTime", _L),
    ("startTrace", _L), ("endTrace", _L), ("locationId", _L),
)

# Boundary reasons of a frame.
REASON_CALL, REASON_TRACE_RESUME, REASON_RETURN = 0, 1, 2
REASON_TRACE_END, REASON_AUX_LOSS, REASON_END_OF_INPUT = 3, 4, 5
REASONS = ["Call", "TraceResume", "Return", "TraceEnd", "AuxLoss", "EndOfInput"]

# Frame kinds, and the cpu mode that means user space.
KIND_USER, KIND_KERNEL = 0, 1
KINDS = ["User", "Kernel"]
CPU_MODE_USER = 2

# Branch flag bits, lowest first.
FLAGS = ["BRANCH", "CALL", "RETURN", "CONDITIONAL", "SYSCALLRET", "ASYNC", "INTERRUPT", "TX_ABORT",
         "TRACE_BEGIN", "TRACE_END", "IN_TX", "VMENTRY", "VMEXIT"]
FLAG_CALL, FLAG_RETURN = 1 << 1, 1 << 2
FLAG_TRACE_BEGIN, FLAG_TRACE_END = 1 << 8, 1 << 9

# How strong the natural key of a location is.
KEY_ADDRESS, KEY_DSO, KEY_BUILD_ID = 0, 1, 2

# Quality bits of a location.
HAS_DSO, HAS_SYMBOL, HAS_SOURCE_LINE = 1, 2, 4
