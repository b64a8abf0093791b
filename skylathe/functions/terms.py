"""Graph terms as strings in N-Triples form: ``<iri>``, ``"text"``, ``"text"@en``, ``"1"^^<type>``, ``_:b``.

Equal terms are equal strings, so joins, grouping and distinct stay native. All helpers are JVM expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
DC = "http://purl.org/dc/elements/1.1/"
#: Name space of a graph's own names, a parameter wherever names are made.
BASE = "https://example.org/maintenance#"

_NUMERIC = tuple(f"<{XSD}{t}>" for t in ("integer", "decimal", "double", "float", "int", "long"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- literals on the driver ----------------------------------------------------------------------------


def escape_py(s: str) -> str:
    return s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def iri_py(s: str) -> str:
    return f"<{s}>"


def literal_py(s: str, lang: str | None = None, datatype: str | None = None) -> str:
    return f'"{escape_py(s)}"' + (f"@{lang}" if lang else f"^^<{datatype}>" if datatype and datatype != XSD + "string" else "")


# ---- column expressions --------------------------------------------------------------------------------


def iri(c: Column | str) -> Column:
    return F.concat(F.lit("<"), _col(c), F.lit(">"))


def escape(c: Column | str) -> Column:
    s = F.replace(_col(c), F.lit("\\"), F.lit("\\\\"))
    for raw, safe in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def unescape(c: Column | str) -> Column:
    """Inverse of ``escape``, sign by sign: each backslash is read with what follows it, so none is read twice."""

    def plain(p: Column) -> Column:
        for raw, safe in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            p = F.replace(p, F.lit(safe), F.lit(raw))
        return p

    return F.array_join(F.transform(F.split(_col(c), r"\\\\", -1), plain), "\\")  # divided at escaped backslashes


def literal(c: Column | str, lang: str | None = None, datatype: str | None = None) -> Column:
    tail = f'"@{lang}' if lang else f'"^^<{datatype}>' if datatype else '"'
    return F.concat(F.lit('"'), escape(c), F.lit(tail))


def integer(c: Column | str) -> Column:
    return F.concat(F.lit('"'), _col(c).cast("bigint").cast("string"), F.lit(f'"^^<{XSD}integer>'))


def double(c: Column | str) -> Column:
    return F.concat(F.lit('"'), _col(c).cast("double").cast("string"), F.lit(f'"^^<{XSD}double>'))


def is_iri(c: Column | str) -> Column:
    return F.startswith(_col(c), F.lit("<"))


def is_literal(c: Column | str) -> Column:
    return F.startswith(_col(c), F.lit('"'))


def is_bnode(c: Column | str) -> Column:
    return F.startswith(_col(c), F.lit("_:"))


_LEX = r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$'


def text(c: Column | str) -> Column:
    """The IRI or the lexical form of a term (STR)."""
    c = _col(c)
    return F.when(is_iri(c), F.substring(c, F.lit(2), F.length(c) - 2)).when(is_literal(c), unescape(F.regexp_extract(c, _LEX, 1))).otherwise(c)


def lang(c: Column | str) -> Column:
    return F.when(is_literal(c), F.regexp_extract(_col(c), r'"@([A-Za-z0-9-]+)$', 1))


def datatype(c: Column | str) -> Column:
    c = _col(c)
    own = F.regexp_extract(c, r'"\^\^(<[^>]*>)$', 1)
    return F.when(is_literal(c), F.when(own != "", own).when(lang(c) != "", F.lit(f"<{RDF}langString>")).otherwise(F.lit(f"<{XSD}string>")))


def number(c: Column | str) -> Column:
    """The value of a numeric literal, else null."""
    return F.when(datatype(c).isin(*_NUMERIC), text(c).try_cast("double"))


def local_name(c: Column | str) -> Column:
    """What follows # in an IRI, else what follows the last /."""
    s = text(c)
    return F.when(F.contains(s, F.lit("#")), F.substring_index(s, "#", -1)).otherwise(F.substring_index(s, "/", -1))


def match_key(c: Column | str) -> Column:
    """Trimmed, in lower case, with single blanks."""
    return F.lower(F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " ")))


def slug(c: Column | str) -> Column:
    """A name for an IRI: only word characters, white space and hyphens stay, each run of letters is
    capitalised (after any non-letter), white space goes."""
    clean = F.regexp_replace(_col(c), r"(?U)[^\w\s-]", "")
    # a blank behind each character that is no letter makes what follows a word of its own; all blanks go at the end
    words = F.regexp_replace(clean, r"(?U)([^\p{L}\s])|\s", "$1 ")
    return F.replace(F.initcap(words), F.lit(" "), F.lit(""))


def slug_sql(e: str) -> str:
    """``slug`` as SQL, for plans of many names: one parse instead of many calls."""
    clean = f"regexp_replace({e}, r'(?U)[^\\w\\s-]', '')"
    return f"replace(initcap(regexp_replace({clean}, r'(?U)([^\\p{{L}}\\s])|\\s', '$1 ')), ' ', '')"


def has_name_sql(e: str) -> str:
    """Whether a slug is not empty, told from the label itself."""
    return f"{e} RLIKE r'(?U)[\\w-]'"


def slug_py(value: str) -> str:
    clean = re.sub(r"[^\w\s-]", "", value)
    cased = "".join(r[:1].upper() + r[1:].lower() for r in re.findall(r"[^\W\d_]+|[\W\d_]+", clean))
    return re.sub(r"\s+", "", cased)


def underscore_slug(c: Column | str) -> Column:
    """Everything but letters and digits separates; parts in lower case joined by underscores."""
    s = F.trim(F.regexp_replace(_col(c), r"(?U)[^\p{L}\p{N}]+", " "))
    return F.replace(F.lower(s), F.lit(" "), F.lit("_"))
