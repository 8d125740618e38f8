"""IP addresses and prefixes as fixed-width columns.

An address is ``(family, hi, lo)``: IPv4 keeps its 32-bit value in ``hi`` and 0 in ``lo``; IPv6 keeps the two
64-bit halves, as signed BIGINTs.  A prefix adds ``plen`` and masks the host bits, so equal networks are equal keys
and containment is an equi-join (see ``operators.covering``).  Text that is no address gives NULL, never an error.
Everything is a built-in expression, so it stays in the JVM; written as SQL text, it is also quick to build.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["family", "net_hi", "net_lo", "plen"]

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_TEXT = rf"^(?:{_OCTET}[.]){{3}}{_OCTET}$"
IPV6_GROUPS = "^[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- masks, as SQL over the names of family, value and length --------------------------------------------------


def _ones(bits: int, plen: str) -> str:
    # The JVM takes shift distances modulo 64, so a full shift is a case of its own.
    return f"CASE WHEN {plen} <= 0 THEN 0L ELSE shiftleft(-1L, {bits} - {plen}) END"


def mask_hi(family: str, hi: str, plen: str) -> str:
    v6 = f"CASE WHEN {plen} >= 64 THEN {hi} ELSE {hi} & {_ones(64, plen)} END"
    return f"CASE WHEN {family} = 4 THEN {hi} & {_ones(32, plen)} ELSE {v6} END"


def mask_lo(family: str, lo: str, plen: str) -> str:
    return f"CASE WHEN {family} = 4 OR {plen} <= 64 THEN 0L ELSE {lo} & {_ones(128, plen)} END"


def max_plen(family: str) -> str:
    return f"CASE WHEN {family} = 4 THEN 32 ELSE 128 END"


# -- parsing --------------------------------------------------------------------------------------------------

_V4 = " + ".join(f"try_cast(get(split(_tail, '[.]'), {i}) AS bigint) * {256 ** (3 - i)}" for i in range(4))
_SIX = "instr(_text, ':') > 0"
_SQUEEZED = "instr(_plain, '::') > 0"


def _groups(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN 0 ELSE length({c}) - length(replace({c}, ':', '')) + 1 END"


def _half(first: int) -> str:
    return f"try_cast(conv(substr(_hex, {first}, 16), 16, -10) AS bigint)"


def _with_parsed(df: DataFrame, text: str) -> DataFrame:
    """Add ``_fam, _hi, _lo`` for an address text given as SQL, all NULL when it is no address.

    The steps are separate projections, so each intermediate is evaluated once.  The result passes through a
    one-element explode: a filter or inferred join condition on it stays above the parse, while without it Catalyst
    would copy the whole parse into every pushed predicate.
    """
    kept = [f"`{c}`" for c in df.columns]
    steps = [
        {"_text": f"trim({text})", "_tail": f"substring_index(trim({text}), ':', -1)"},
        {"_text": "_text", "_v4": f"CASE WHEN _tail RLIKE r'{IPV4_TEXT}' THEN {_V4} END"},
        # an IPv4 tail becomes two hex groups
        {
            "_text": "_text",
            "_v4": "_v4",
            "_plain": f"CASE WHEN {_SIX} AND instr(_text, '.') > 0 THEN concat(regexp_extract(_text, '^(.*:)[0-9.]+$', 1), "
            f"hex(shiftright(_v4, 16)), ':', hex(_v4 & 65535)) WHEN {_SIX} THEN _text END",
        },
        # "::" stands for as many zero groups as are missing from eight
        {
            "_text": "_text",
            "_v4": "_v4",
            "_plain": "_plain",
            "_left": f"CASE WHEN {_SQUEEZED} THEN substring_index(_plain, '::', 1) END",
            "_right": f"CASE WHEN {_SQUEEZED} THEN substr(_plain, instr(_plain, '::') + 2) END",
        },
        {
            "_text": "_text",
            "_v4": "_v4",
            "_plain": "_plain",
            "_left": "_left",
            "_right": "_right",
            "_missing": f"8 - ({_groups('_left')}) - ({_groups('_right')})",
        },
        {
            "_text": "_text",
            "_v4": "_v4",
            "_full": f"CASE WHEN {_SQUEEZED} THEN CASE WHEN _missing >= 1 THEN concat_ws(':', nullif(_left, ''), "
            "substr(repeat(':0', _missing), 2), nullif(_right, '')) END ELSE _plain END",
        },
        {"_text": "_text", "_v4": "_v4", "_g": f"CASE WHEN _full RLIKE r'{IPV6_GROUPS}' THEN split(_full, ':') END"},
        {"_text": "_text", "_v4": "_v4", "_hex": "concat(" + ", ".join(f"lpad(get(_g, {i}), 4, '0')" for i in range(8)) + ")"},
    ]
    staged = df
    for step in steps:
        staged = staged.selectExpr(*kept, *[f"{sql} AS {name}" if sql != name else name for name, sql in step.items()])
    parsed = (
        f"named_struct('_fam', CASE WHEN {_SIX} THEN CASE WHEN _hex IS NOT NULL THEN 6 END WHEN _v4 IS NOT NULL THEN 4 END, "
        f"'_hi', CASE WHEN {_SIX} THEN {_half(1)} ELSE _v4 END, "
        f"'_lo', CASE WHEN {_SIX} THEN {_half(17)} WHEN _v4 IS NOT NULL THEN 0L END)"
    )
    return staged.selectExpr(*kept, f"explode(array({parsed})) AS _addr").selectExpr(*kept, "_addr.*")


def with_address(df: DataFrame, text: str, drop_invalid: bool = True) -> DataFrame:
    """Add ``family, hi, lo`` of the address in column ``text``."""
    parsed = _with_parsed(df, f"`{text}`")
    if drop_invalid:
        parsed = parsed.where("_fam IS NOT NULL")
    return parsed.withColumnsRenamed({"_fam": "family", "_hi": "hi", "_lo": "lo"})


def with_network(df: DataFrame, text: str = "prefix", drop_invalid: bool = True) -> DataFrame:
    """Add the canonical key ``family, net_hi, net_lo, plen``; a prefix without a length is a host route."""
    kept = [f"`{c}`" for c in df.columns]
    trimmed = f"trim(`{text}`)"
    length = f"substring_index({trimmed}, '/', -1)"
    plen = (
        f"CASE WHEN instr({trimmed}, '/') > 0 THEN CASE WHEN {length} RLIKE '^[0-9]{{1,3}}$' THEN try_cast({length} AS int) END "
        f"ELSE {max_plen('_fam')} END"
    )
    parsed = _with_parsed(df, f"substring_index({trimmed}, '/', 1)").selectExpr(*kept, "_fam", "_hi", "_lo", f"{plen} AS _plen")
    valid = f"_fam IS NOT NULL AND _plen <= {max_plen('_fam')}"
    if drop_invalid:
        parsed, valid = parsed.where(valid), "true"
    return parsed.selectExpr(
        *kept,
        f"CASE WHEN {valid} THEN _fam END AS family",
        f"CASE WHEN {valid} THEN {mask_hi('_fam', '_hi', '_plen')} END AS net_hi",
        f"CASE WHEN {valid} THEN {mask_lo('_fam', '_lo', '_plen')} END AS net_lo",
        f"CASE WHEN {valid} THEN _plen END AS plen",
    )


# -- text -----------------------------------------------------------------------------------------------------


def _squeezed_zeros(eight: str) -> str:
    """The longest run of two or more zero groups, leftmost on ties, becomes ``::``."""
    cases = []
    for run in range(8, 1, -1):
        pattern = "^(?:(.*?):)??0" + ":0" * (run - 1) + "(?::(.*))?$"
        cases.append(f"WHEN {eight} RLIKE r'{pattern}' THEN regexp_replace({eight}, r'{pattern}', '$1::$2')")
    return f"CASE {' '.join(cases)} ELSE {eight} END"


def with_canonical_text(df: DataFrame, out: str = "prefix") -> DataFrame:
    """Add the canonical text of the masked network ``family, net_hi, net_lo, plen``."""
    quad = ", ".join(f"shiftright(net_hi, {s}) & 255" for s in (24, 16, 8, 0))
    groups = ", ".join(
        f"lower(hex(shiftrightunsigned({half}, {s}) & 65535))" for half in ("net_hi", "net_lo") for s in (48, 32, 16, 0)
    )
    six = f"get(transform(array(concat_ws(':', {groups})), t -> {_squeezed_zeros('t')}), 0)"
    four = f"concat_ws('.', {quad})"
    text = F.expr(f"concat(CASE WHEN family = 4 THEN {four} WHEN family = 6 THEN {six} END, '/', plen)")
    return df.withColumn(out, text)
