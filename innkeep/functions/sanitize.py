"""``sanitize_text``: strip unsafe HTML from a string column, then trim.

An approximation of a DOM sanitizer from built-in functions only (JVM-side).
The text is cut into tokens once, by one pattern: comments, elements whose
content is never kept (to their end tag, or to the end of the text), tags, and
plain text.  Plain text is kept as it is.  Only a tag's own text is cleaned:
its name must be on the allow-list (else the tag goes and its content stays),
event handlers, frame documents and form targets go, and link attributes keep
only relative addresses and harmless schemes.  A kept tag is written anew from
its parts (lower case, quoted values), so no removal can form another tag; a
lone ``<`` before a removed token becomes ``&lt;``.  Text without ``<`` is only
trimmed.  Patterns use syntax that Java and RE2 read the same way.

Known differences from a DOM: no entity re-encoding of text, no repair of
unbalanced tags, a ``>`` inside a quoted value ends the tag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from innkeep.functions.text import js_trim

# Elements removed together with their content ...
DROP_WITH_CONTENT = ("script", "style", "iframe", "noscript", "template", "title", "noembed", "noframes", "xmp", "plaintext")
# ... element names that may stay (HTML, then drawing and formula markup) ...
ALLOWED_TAGS = tuple("""
a abbr acronym address area article aside audio b bdi bdo big blink blockquote br button canvas caption center cite code
col colgroup data datalist dd del details dfn dialog dir div dl dt em fieldset figcaption figure font footer form
h1 h2 h3 h4 h5 h6 header hgroup hr i img input ins kbd label legend li main map mark marquee menu meter nav nobr ol
optgroup option output p picture pre progress q rp rt ruby s samp search section select small source span strike strong sub
summary sup table tbody td textarea tfoot th thead time tr track tt u ul var video wbr
svg circle clippath defs desc ellipse g line lineargradient marker mask path pattern polygon polyline radialgradient rect
stop switch symbol text textpath tspan
math mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover
""".split())
# ... attributes that never stay (besides on*) and attributes that hold an address.
DROP_ATTRIBUTES = ("srcdoc", "formaction", "target", "ping")
URL_ATTRIBUTES = ("href", "src", "action", "xlink:href", "poster", "background", "cite", "longdesc")

_WS = r"[\t\n\f\r ]"
_TAIL = r"(?:[\t\n\f\r /][^>]*)?>"
TOKEN = ("(?is)<!--.*?(?:-->|\\z)|<head" + _TAIL + ".*?</head" + _TAIL + "|"
         + "|".join(f"<{t}{_TAIL}.*?(?:</{t}{_TAIL}|\\z)" for t in DROP_WITH_CONTENT)
         + r"|<[/!?a-z][^>]*(?:>|\z)|<?[^<]+|<")
TAG = r"(?is)^</?[a-z][^\t\n\f\r />]*"
ATTRIBUTE = r"""[^\t\n\f\r "'>/=]+(?:""" + _WS + "*=" + _WS + r"""*(?:"[^"]*"|'[^']*'|[^\t\n\f\r "'>]+))?"""
SAFE_URL = (r"^(?:(?:https?|ftp|mailto|tel|sms|callto|cid|xmpp|matrix):|data:image/|[^a-z]|[a-z+.\-]+(?:[^a-z+.\-:]|\z)|\z)")
HIDDEN = r"[\x00-\x20\x7f\x{a0}\x{1680}\x{180e}\x{2000}-\x{2029}\x{205f}\x{3000}]"   # spaces and controls an address may hide
ENCODED = "&(?:#|colon|tab|newline)"


def _attribute(a: Column) -> Column:
    """An attribute written anew (``name="value"``), NULL when it must go."""
    name = F.lower(F.regexp_extract(a, r"^[^\t\n\f\r =]+", 0))
    raw = F.when(a.contains("="), F.regexp_replace(a, "(?s)^[^=]*=" + _WS + "*", "")).otherwise(F.lit(""))
    quoted = F.substring(raw, 1, 1).isin('"', "'")
    value = F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    url = F.lower(F.regexp_replace(value, HIDDEN, ""))
    bad = (name.startswith("on") | name.isin(*DROP_ATTRIBUTES)
           | (name.isin(*URL_ATTRIBUTES) & (~url.rlike(SAFE_URL) | url.rlike(ENCODED))))
    return F.when(~bad, F.concat(name, F.lit('="'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('"')))


def _token(t: Column) -> Column:
    head = F.regexp_extract(t, TAG, 0)
    name = F.lower(F.regexp_replace(head, "^</?", ""))
    attributes = F.array_compact(F.transform(F.regexp_extract_all(F.substring(t, F.length(head) + 1, F.length(t)),
                                                                  F.lit(ATTRIBUTE), F.lit(0)), _attribute))
    opened = F.concat(F.lit("<"), F.array_join(F.concat(F.array(name), attributes), " "), F.lit(">"))
    return (F.when(t == "<", F.lit("&lt;"))
            .when(~t.rlike("(?i)^<[/!?a-z]"), t)
            .when(~name.isin(*ALLOWED_TAGS), F.lit(""))
            .when(t.startswith("</"), F.concat(F.lit("</"), name, F.lit(">")))
            .otherwise(opened))


def sanitize_text(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    tokens = F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0))
    return js_trim(F.when(col.contains("<"), F.array_join(F.transform(tokens, _token), "")).otherwise(col))


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sanitize_sql(col: str) -> str:
    """The same rules as one DuckDB expression (for the oracle)."""
    def q(p):
        return "'" + p.replace("'", "''") + "'"
    raw = f"CASE WHEN contains(a, '=') THEN regexp_replace(a, {q('(?s)^[^=]*=' + _WS + '*')}, '') ELSE '' END"
    val = f"CASE WHEN ({raw})[1] IN ('\"', '''') THEN ({raw})[2:length({raw}) - 1] ELSE ({raw}) END"
    url = f"lower(regexp_replace({val}, {q(HIDDEN)}, '', 'g'))"
    name = r"lower(regexp_extract(a, '^[^\t\n\f\r =]+'))"
    bad = (f"(starts_with({name}, 'on') OR {name} IN ({_names(DROP_ATTRIBUTES)}) OR ({name} IN ({_names(URL_ATTRIBUTES)}) AND "
           f"(NOT regexp_matches({url}, {q(SAFE_URL)}) OR regexp_matches({url}, {q(ENCODED)}))))")
    head = f"regexp_extract(t, {q(TAG)})"
    tag = f"lower(regexp_replace({head}, '^</?', ''))"
    found = f"list_filter(regexp_extract_all(t[length({head}) + 1:], {q(ATTRIBUTE)}), lambda a: NOT {bad})"
    written = f"""list_transform({found}, lambda a: ' ' || {name} || '="' || replace({val}, '"', '&quot;') || '"')"""
    token = (f"CASE WHEN t = '<' THEN '&lt;' WHEN NOT regexp_matches(t, '(?i)^<[/!?a-z]') THEN t "
             f"WHEN {tag} NOT IN ({_names(ALLOWED_TAGS)}) THEN '' WHEN starts_with(t, '</') THEN '</' || {tag} || '>' "
             f"ELSE '<' || {tag} || array_to_string({written}, '') || '>' END")
    expr = f"array_to_string(list_transform(regexp_extract_all({col}, {q(TOKEN)}), lambda t: {token}), '')"
    guarded = f"CASE WHEN contains({col}, '<') THEN {expr} ELSE {col} END"
    return f"regexp_replace({guarded}, '^\\s+|\\s+$', '', 'g')"
