"""AS paths, communities, aggregators, and the two ways of normalizing an AS number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .netaddr import _col

DIGITS = "^[0-9]+$"
# A path of numbers only, each surely a BIGINT.  Nearly all paths are of this form, and one regular expression inside
# generated code is much cheaper than taking the path apart.  Possessive, as the JVM matches a repeated group that may
# give way by recursion, and a long path would overrun the stack of the executor.
PLAIN_PATH = r"^\s*+[0-9]{1,18}+(?:\s++[0-9]{1,18}+)*+\s*+$"

# A plain path that is its own normal form: single blanks, no leading zeros.  Its parts are cut out of the text.
NORMAL_PATH = r"^[1-9][0-9]{0,17}+(?: [1-9][0-9]{0,17}+)*+\z"


def path_tokens(path: Column | str) -> Column:
    """Whitespace-separated tokens; NULL in, NULL out; blank in, empty array out."""
    return F.filter(F.split(_col(path), r"\s+"), lambda t: t != "")


def _set_head(token: Column) -> Column:
    return F.get(F.split(F.btrim(token, F.lit("{}")), ","), F.lit(0))


def _lenient_number(token: Column) -> Column:
    """AS number a RIB token stands for: first member of a set, nothing for ``(``, digits as they are."""
    text = F.when(F.contains(token, F.lit("{")), _set_head(token)).when(~F.contains(token, F.lit("(")), token)
    return F.when(text.rlike(DIGITS), text.try_cast("bigint"))


def path_numbers(path: Column | str) -> Column:
    """Lenient parse of a RIB path to ``ARRAY<BIGINT>``; tokens that are no number are left out."""
    return F.filter(F.transform(path_tokens(path), _lenient_number), lambda n: n.isNotNull())


def has_numbers(path: Column | str) -> Column:
    """Whether the lenient parse finds a number."""
    return _col(path).rlike(PLAIN_PATH) | (F.size(path_numbers(path)) > 0)


def is_strict(path: Column | str) -> Column:
    """Whether every token is a number, and there is one."""
    return _col(path).rlike(PLAIN_PATH) | strict_path_numbers(path).isNotNull()


def normalized_path(path: Column | str) -> Column:
    """Numbers joined by blanks; the raw tokens when no number was found; NULL for an empty path."""
    tokens, numbers = path_tokens(path), path_numbers(path)
    return (
        F.when(_col(path).rlike(NORMAL_PATH), _col(path))
        .when(F.size(numbers) > 0, F.array_join(F.transform(numbers, lambda n: n.cast("string")), " "))
        .when(F.size(tokens) > 0, F.array_join(tokens, " "))
    )


def path_origin(path: Column | str) -> Column:
    """Last number of the lenient parse."""
    last = F.substring_index(_col(path), " ", -1).try_cast("bigint")
    return F.when(_col(path).rlike(NORMAL_PATH), last).otherwise(F.try_element_at(path_numbers(path), F.lit(-1)))


def origin_is_set(path: Column | str) -> Column:
    """True when the origin came out of an AS set, whose origin RFC 6811 takes as none."""
    kept = F.filter(path_tokens(path), lambda t: _lenient_number(t).isNotNull())
    found = F.when(F.contains(_col(path), F.lit("{")), F.contains(F.try_element_at(kept, F.lit(-1)), F.lit("{")))
    return F.coalesce(found, F.lit(False))


def strict_path_numbers(path: Column | str) -> Column:
    """Path of an update: every token must be a number, else NULL (the announcement is ignored)."""
    tokens = path_tokens(path)
    numbers = F.transform(tokens, lambda t: t.try_cast("bigint"))
    usable = (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.rlike(DIGITS))
    return F.when(usable & ~F.exists(numbers, lambda n: n.isNull()), numbers)


def raw_origin(path: Column | str) -> Column:
    """Last token of a path, unparsed."""
    return F.try_element_at(path_tokens(path), F.lit(-1))


def communities_text(communities: Column | str, kind: str = "pairs") -> Column:
    """Communities as text, items joined by blanks; empty is NULL.

    ``kind`` says what they are: ``pairs``, ``ARRAY<STRUCT<asn, value>>`` that become ``asn:value`` with missing parts
    as 0; ``items``, an array of texts; ``text``, kept as it is.
    """
    if kind == "text":
        return F.nullif(_col(communities).cast("string"), F.lit(""))
    if kind == "items":
        return F.nullif(F.array_join(_col(communities), " "), F.lit(""))
    part = lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    items = F.transform(
        _col(communities), lambda c: F.concat(part(c["asn"]), F.lit(":"), part(c["value"]))
    )
    return F.nullif(F.array_join(items, " "), F.lit(""))


def aggregator_as(text: Column | str) -> Column:
    """Part before the first colon, NULL when there is none."""
    text = _col(text)
    return F.when(F.instr(text, ":") > 0, F.substring_index(text, ":", 1))


def aggregator_address(text: Column | str) -> Column:
    """Part after the first colon, NULL when there is none."""
    text = _col(text)
    return F.when(F.instr(text, ":") > 0, F.substr(text, F.instr(text, ":") + 1))


def epoch_timestamp(seconds: Column | str) -> Column:
    """Seconds since 1970 to a timestamp; 0 and NULL give NULL."""
    seconds = _col(seconds)
    return F.when(seconds != 0, F.timestamp_seconds(seconds))


def rib_timestamp(text: Column | str) -> Column:
    """``20250504.0800`` to a timestamp."""
    return F.try_to_timestamp(_col(text), F.lit("yyyyMMdd.HHmm"))


def asked_asn(text: Column | str) -> Column:
    """Origin asked for in a validation: one leading ``AS`` is dropped."""
    return F.regexp_replace(_col(text).cast("string"), "^AS", "")


def roa_asn(text: Column | str) -> Column:
    """Origin of an authorization: every ``AS`` is dropped, missing is empty."""
    return F.replace(F.coalesce(_col(text).cast("string"), F.lit("")), F.lit("AS"), F.lit(""))


def registry_asn(text: Column | str) -> Column:
    """Origin in a registry record: every ``AS`` dropped, trimmed, kept only when all digits."""
    text = F.trim(F.replace(_col(text).cast("string"), F.lit("AS"), F.lit("")))
    return F.when(text.rlike(DIGITS), text)
