"""Column -> Column functions. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stackweave import schemas as S

ColumnLike = Column | str


def _col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_empty(text: ColumnLike) -> Column:
    return F.coalesce(F.length(_col(text)) == 0, F.lit(True))


def utf8_or_null(value: ColumnLike) -> Column:
    """Bytes (or text) to text; bytes that are not UTF-8 become replacement characters, empty becomes null."""
    return F.nullif(F.make_valid_utf8(_col(value).cast("string")), F.lit(""))


def unsigned_hex(value: ColumnLike) -> Column:
    """Lower-case hex of an unsigned 64-bit number held as decimal or long."""
    return F.lower(F.conv(_col(value).cast("string"), 10, 16))


def base_name(path: ColumnLike) -> Column:
    return F.substring_index(_col(path), "/", -1)


def display_name(symbol: ColumnLike, file: ColumnLike, line: ColumnLike, dso: ColumnLike,
                 address: ColumnLike) -> Column:
    """Symbol, else file:line, else dso+0xaddr, else 0xaddr, else ''."""
    hex_address = F.concat(F.lit("0x"), unsigned_hex(address))
    return (
        F.when(~is_empty(symbol), _col(symbol))
        .when(~is_empty(file) & (_col(line) != 0),
              F.concat(base_name(file), F.lit(":"), _col(line).cast("string")))
        .when(~is_empty(dso), F.concat(base_name(dso), F.lit("+"), hex_address))
        .when(_col(address) == 0, F.lit(""))
        .otherwise(hex_address)
    )


def event_name(location_id: ColumnLike, display: ColumnLike, fallback: ColumnLike) -> Column:
    """Display name, else the name seen in samples, else `Unknown` / `location:<id>`."""
    unnamed = F.when(_col(location_id) == 0, F.lit("Unknown")).otherwise(
        F.concat(F.lit("location:"), _col(location_id).cast("string")))
    named = F.coalesce(F.nullif(_col(display), F.lit("")), F.nullif(_col(fallback), F.lit("")))
    return F.when(_col(location_id) == 0, unnamed).otherwise(F.coalesce(named, unnamed))


def source_location_struct(symbol: ColumnLike, file: ColumnLike, line: ColumnLike) -> Column:
    """{function, file, line}; null when neither symbol nor file is known."""
    return F.when(
        ~(is_empty(symbol) & is_empty(file)),
        F.struct(F.nullif(_col(symbol), F.lit("")).alias("function"),
                 F.nullif(_col(file), F.lit("")).alias("file"),
                 F.nullif(_col(line).cast("long"), F.lit(0).cast("long")).alias("line")),
    )


# The top four bits of a track id name the kind of track.
_PROCESS_TRACK, _THREAD_TRACK, _STACK_TRACK = 1 << 60, 2 << 60, 3 << 60
LOSS_TRACK = 4 << 60


def process_track(pid: ColumnLike) -> Column:
    return F.lit(_PROCESS_TRACK).bitwiseOR(_col(pid).cast("long"))


def thread_track(pid: ColumnLike, tid: ColumnLike) -> Column:
    return (F.lit(_THREAD_TRACK).bitwiseOR(F.shiftleft(_col(pid).cast("long"), 32))
            .bitwiseOR(_col(tid).cast("long")))


def stack_track(pid: ColumnLike, tid: ColumnLike, kind: ColumnLike) -> Column:
    return (F.lit(_STACK_TRACK).bitwiseOR(F.shiftleft(_col(kind).cast("long"), 56))
            .bitwiseOR(F.shiftleft(_col(pid).cast("long"), 32)).bitwiseOR(_col(tid).cast("long")))


def sequence_id(track: ColumnLike) -> Column:
    """Low 32 bits of a track id."""
    return _col(track).bitwiseAND(F.lit(0xFFFFFFFF))


def process_name(pid: ColumnLike) -> Column:
    return F.when(_col(pid) == 0, F.lit("Unknown process")).otherwise(
        F.concat(F.lit("Process "), _col(pid).cast("string")))


def stack_track_name(thread_name: ColumnLike, kind: ColumnLike) -> Column:
    side = F.when(_col(kind) == S.KIND_KERNEL, F.lit("kernel")).otherwise(F.lit("user"))
    return F.concat(_col(thread_name), F.lit(" / "), side)


def loss_marker_name(tid: ColumnLike, cpu: ColumnLike, flags: ColumnLike) -> Column:
    return F.concat(F.lit("AUX loss tid="), _col(tid).cast("string"), F.lit(" cpu="),
                    _col(cpu).cast("string"), F.lit(" flags=0x"), unsigned_hex(flags))


def quality_bits(dso: ColumnLike, symbol: ColumnLike, file: ColumnLike, line: ColumnLike) -> Column:
    def bit(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    return (bit(~is_empty(dso), S.HAS_DSO) + bit(~is_empty(symbol), S.HAS_SYMBOL)
            + bit(~is_empty(file) & (_col(line) != 0), S.HAS_SOURCE_LINE))


def percent_text(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    share = _col(numerator).cast("double") / F.nullif(_col(denominator), F.lit(0)).cast("double")
    return F.when(_col(denominator) != 0, F.format_string("%.2f%%", share * 100)).otherwise(F.lit("0.00%"))


def key_strength(build_id: ColumnLike, dso: ColumnLike) -> Column:
    return (F.when(~is_empty(build_id), F.lit(S.KEY_BUILD_ID))
            .when(~is_empty(dso), F.lit(S.KEY_DSO)).otherwise(F.lit(S.KEY_ADDRESS)))


def partition_value(path: ColumnLike, prefix: str) -> Column:
    """Number in the last `<prefix>=<digits>` directory of a path, else null."""
    digits = F.regexp_extract(_col(path), rf"(?:^|/){prefix}=(\d+)(?:/|$)", 1)
    number = digits.try_cast("bigint")
    return F.when(number <= 4294967295, number)


def split_file_key(key: ColumnLike) -> Column:
    """`pid=…/tid=…/file` to its parts; any other key to (-, -, key)."""
    parts = F.split(_col(key), "/")
    dash = F.lit("-")
    whole = F.size(parts) >= 3
    return F.struct(
        F.when(whole, F.try_element_at(parts, F.lit(1))).otherwise(dash).alias("pidPart"),
        F.when(whole, F.try_element_at(parts, F.lit(2))).otherwise(dash).alias("tidPart"),
        F.when(whole, F.try_element_at(parts, F.lit(-1))).otherwise(_col(key)).alias("filePart"),
    )


def format_trace_time(nanoseconds: ColumnLike) -> Column:
    """`<seconds>.<9 digits>s`, seconds rounded down; null becomes `-`."""
    ns = _col(nanoseconds).cast("long")
    rest = F.pmod(ns, F.lit(1_000_000_000))
    seconds = F.floor((ns - rest).cast("decimal(20,0)") / 1_000_000_000)
    text = F.concat(seconds.cast("string"), F.lit("."),
                    F.lpad(rest.cast("string"), 9, "0"), F.lit("s"))
    return F.coalesce(text, F.lit("-"))


def parse_trace_time(text: ColumnLike) -> Column:
    """`sec.fraction` to nanoseconds; the fraction is scaled by its digit count; else null."""
    seconds = F.regexp_extract(_col(text), r"^(\d+)\.(\d+)$", 1)
    fraction = F.regexp_extract(_col(text), r"^(\d+)\.(\d+)$", 2)
    nanos = F.rpad(F.substring(fraction, 1, 9), 9, "0").try_cast("bigint")
    return seconds.try_cast("bigint") * 1_000_000_000 + nanos


def strip_symbol_offset(symbol: ColumnLike) -> Column:
    return F.nullif(F.substring_index(_col(symbol), "+", 1), F.lit(""))


def flag_names(flags: ColumnLike) -> Column:
    """Names of the set branch flag bits, lowest first, joined with `|`."""
    names = [F.when(_col(flags).bitwiseAND(F.lit(1 << bit)) != 0, F.lit(name))
             for bit, name in enumerate(S.FLAGS)]
    return F.concat_ws("|", *names)


def _label(code: ColumnLike, labels: list[str]) -> Column:
    chain = F.when(_col(code) == 0, F.lit(labels[0]))
    for value, label in enumerate(labels[1:], start=1):
        chain = chain.when(_col(code) == value, F.lit(label))
    return chain


def reason_label(code: ColumnLike) -> Column:
    return _label(code, S.REASONS)


def kind_label(code: ColumnLike) -> Column:
    return _label(code, S.KINDS)


def event_component(event: ColumnLike) -> Column:
    """File name stem of an event: the part before `:`; unsafe names become upper-case hex."""
    stem = F.substring_index(_col(event), ":", 1)
    return (F.when(is_empty(stem), F.lit("unknown"))
            .when(stem.rlike(r"\A[A-Za-z0-9_.-]+\z"), stem)
            .otherwise(F.hex(F.encode(stem, "UTF-8"))))


def symbol_match(actual: ColumnLike, wanted: ColumnLike) -> Column:
    """`main` matches exactly, any other wanted name as a substring."""
    return (F.when(_col(wanted) == "main", _col(actual) == "main")
            .otherwise(F.contains(_col(actual), _col(wanted))))


def stack_kind(cpumode: ColumnLike) -> Column:
    return F.when(_col(cpumode) == S.CPU_MODE_USER, F.lit(S.KIND_USER)).otherwise(F.lit(S.KIND_KERNEL))
