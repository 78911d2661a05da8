"""Text escapes of JSON, XML and the two resource formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chain(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# JSON's short escapes; other control characters use \u00xx, hex in lower case.
_JSON_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_JSON_PAIRS = [("\\", "\\\\"), ('"', '\\"')] + [
    (chr(c), _JSON_SHORT.get(chr(c), f"\\u{c:04x}")) for c in range(32)
]


def json_escape(text: Column) -> Column:
    """The inside of a JSON string literal."""
    return F.when(text.rlike(r'[\x00-\x1f"\\]'), _chain(text, _JSON_PAIRS)).otherwise(text)


def json_string(text: Column) -> Column:
    return F.concat(F.lit('"'), json_escape(text), F.lit('"'))


# The five XML entities, the ampersand last so that nothing decodes twice.
_XML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def xml_decode(text: Column) -> Column:
    return _chain(text, _XML_ENTITIES)


# A stand-in for an escaped backslash while the other escapes are resolved; never valid in XML.
_MARK = "\x00"


def android_unescape(text: Column) -> Column:
    r"""Backslash escapes left to right: ``\n``, ``\t``, otherwise the escaped character itself."""
    paired = F.replace(text, F.lit("\\\\"), F.lit(_MARK))
    named = _chain(paired, [("\\n", "\n"), ("\\t", "\t")])
    plain = F.regexp_replace(named, r"\\([\s\S])", "$1")
    return F.when(text.contains("\\"), F.replace(plain, F.lit(_MARK), F.lit("\\"))).otherwise(text)


def android_decode(text: Column) -> Column:
    return android_unescape(xml_decode(text))


def android_escape(text: Column) -> Column:
    """Percent signs that start no format token are doubled; then XML and backslash escapes."""
    percent = F.regexp_replace(text, r"%(?!(?:[0-9]+\$)?[sdf])", "%%")
    body = _chain(percent, [("\\", "\\\\"), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"),
                            ("\n", "\\n"), ("\t", "\\t"), ('"', '\\"'), ("'", "\\'")])
    return F.regexp_replace(body, r"\A([@?])", r"\\$1")


def ios_escape(text: Column) -> Column:
    return json_escape(text)


def xml_comment(text: Column) -> Column:
    """A comment may hold no double hyphen."""
    return F.replace(text, F.lit("--"), F.lit("- -"))
