"""Parts and normal forms of URLs as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Fixed values.
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "gopher": "70", "ws": "80", "wss": "443"}


def part(url: Column, name: str) -> Column:
    """protocol, authority, path, query, fragment, userinfo, host, port, directory, filename, suffix, domain or tld; '' where absent."""
    at = {"protocol": 1, "authority": 2, "path": 3, "query": 4, "fragment": 5}
    if name in at:
        return F.regexp_extract(url, _PARTS, at[name])
    authority, path = part(url, "authority"), part(url, "path")
    host = F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)
    return {
        "userinfo": lambda: F.regexp_extract(authority, "^([^@]*)@", 1),
        "host": lambda: host,
        "port": lambda: F.regexp_extract(authority, r":([0-9]+)$", 1),
        "directory": lambda: F.regexp_extract(path, "^(.*)/[^/]*$", 1),
        "filename": lambda: F.regexp_extract(path, "([^/]*)$", 1),
        "suffix": lambda: F.regexp_extract(path, r"\.([^./]*)$", 1),
        "domain": lambda: F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        "tld": lambda: F.regexp_extract(host, r"([^.]+)$", 1),
    }[name]()


def parameters(url: Column) -> Column:
    """The query as an array of (key, value); a key without = has a null value."""
    pairs = F.filter(F.split(part(url, "query"), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("key"), F.when(F.contains(p, F.lit("=")), F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("value")))


def normalise(url: Column) -> Column:
    """Lower-case scheme and host, without default port, empty path as /, without empty query or fragment."""
    scheme, host, port = F.lower(part(url, "protocol")), F.lower(part(url, "host")), part(url, "port")
    default = F.lit(False)
    for s, p in DEFAULT_PORTS.items():
        default = default | ((scheme == s) & (port == p))
    user, path, query, fragment = (part(url, n) for n in ("userinfo", "path", "query", "fragment"))
    tail = F.concat(F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    return F.concat(scheme, F.lit("://"), F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""), host, F.when((port != "") & ~default, F.concat(F.lit(":"), port)).otherwise(""), tail)


def encode_component(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def decode_component(text: Column) -> Column:
    """The inverse of encode_component; a plus sign stays one. Null where an escape is broken."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def allowed(url: Column, patterns: list[str]) -> Column:
    """Whether all patterns of an allow-list match."""
    ok = F.lit(True)
    for p in patterns:
        ok = ok & url.rlike(p)
    return ok


def disallowed_topics(links: DataFrame, patterns: list[str]) -> DataFrame:
    """links(doc_id, topic_id, url) to (doc_id, topics): the topics with a link that isn't allowed, each once, joined by commas in order."""
    bad = links.where(~allowed(F.coalesce("url", F.lit("")), patterns)).select("doc_id", "topic_id").distinct()
    return bad.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("topic_id")), lambda t: t.cast("string")), ",").alias("topics"))


#: What addresses, ids of outlines and names of files have to look like.
VALID = {"page": r"^https://[^/]+/docs/DOC-(\d+)$", "spec": r"^\d+$", "archive": r"(?i)\.zip$", "xml": r"(?i)\.xml$", "office": r"(?i)\.odt$"}


def is_valid(text: Column, kind: str) -> Column:
    return F.coalesce(text.rlike(VALID[kind]), F.lit(False))


def with_query(url: Column, pairs: Column) -> Column:
    """A URL with an array of (key, value) as its query; a null value is a key alone, no pairs no query."""
    shown = F.transform(pairs, lambda p: F.concat(encode_component(p["key"]), F.coalesce(F.concat(F.lit("="), encode_component(p["value"])), F.lit(""))))
    query = F.when(F.size(shown) > 0, F.concat(F.lit("?"), F.array_join(shown, "&"))).otherwise("")
    return F.concat(F.regexp_extract(url, "^([^?#]*)", 1), query, F.regexp_extract(url, "(#.*)$", 1))


def add_query(url: Column, key: Column, value: Column) -> Column:
    """The URL with one parameter more."""
    return with_query(url, F.array_append(parameters(url), F.struct(key.alias("key"), value.alias("value"))))


def remove_query(url: Column, key: Column) -> Column:
    return with_query(url, F.filter(parameters(url), lambda p: p["key"] != key))


def has_query(url: Column, key: Column) -> Column:
    return F.exists(parameters(url), lambda p: p["key"] == key)


def common_path(a: Column, b: Column) -> Column:
    """The longest folder that two paths share, with its slash; '' if they share none."""
    x, y = F.split(F.regexp_extract(a, "^(.*/)", 1), "(?<=/)"), F.split(F.regexp_extract(b, "^(.*/)", 1), "(?<=/)")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    shared = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)), F.size(same).cast("long") + 1) - 1
    return F.array_join(F.slice(x, F.lit(1), F.greatest(shared, F.lit(0)).cast("int")), "")


def find_urls(text: Column) -> Column:
    """The URLs in a text, in order, without the punctuation behind them."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:https?|ftp)://[^\s<>\"']+"), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", ""))


def public_suffix(host: Column, second_levels: list[str]) -> Column:
    """The last two labels where they are on the list of second-level suffixes (like co.uk), else the last."""
    last, two = F.regexp_extract(host, r"([^.]+)$", 1), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(F.lower(two).isin([s.lower() for s in second_levels]), two).otherwise(last)


def registered_domain(host: Column, second_levels: list[str]) -> Column:
    """The public suffix and one label more; the host itself if it has none."""
    three, two = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    long = F.lower(two).isin([s.lower() for s in second_levels])
    return F.coalesce(F.nullif(F.when(long, three).otherwise(two), F.lit("")), host)


def mime_type(path: Column, types: dict[str, str] | None = None) -> Column:
    """By the suffix, upper or lower case; types adds to or overrides the interpreter's own table. Unknown: octet-stream."""
    import mimetypes

    known = mimetypes.types_map | {k if k.startswith(".") else f".{k}": v for k, v in (types or {}).items()}
    table = F.create_map(*(F.lit(x) for kv in sorted(known.items()) for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))), F.lit("application/octet-stream"))


def _each(f):
    """A text function as a vectorised column function; null stays null."""
    return F.pandas_udf(lambda s: s.map(f, na_action="ignore"), "string")


def _compact(host: str) -> str:
    import ipaddress

    inner = host[1:-1] if host.startswith("[") and host.endswith("]") else host
    try:
        short = ipaddress.IPv6Address(inner).compressed
    except ValueError:
        return host
    return f"[{short}]" if inner != host else short


def compact_ipv6(host: Column) -> Column:
    """The shortest form of an IPv6 address, with its brackets; other hosts as they are."""
    return _each(_compact)(host)


def _ascii(host: str) -> str:
    return ".".join(p if p.isascii() else "xn--" + p.lower().encode("punycode").decode("ascii") for p in host.split("."))


def _unicode(host: str) -> str:
    def label(p: str) -> str:
        try:
            return p[4:].encode("ascii").decode("punycode") if p.lower().startswith("xn--") else p
        except (UnicodeError, ValueError):
            return p

    return ".".join(label(p) for p in host.split("."))


def to_punycode(host: Column) -> Column:
    """Labels with letters beyond ASCII in their xn-- form."""
    return _each(_ascii)(host)


def from_punycode(host: Column) -> Column:
    """xn-- labels as letters; broken ones stay."""
    return _each(_unicode)(host)


#: Fixed values (RFC 6570): operator: first, separator, with names, name of an empty value, reserved letters stay.
_TEMPLATE = {
    "": ("", ",", False, "", False),
    "+": ("", ",", False, "", True),
    "#": ("#", ",", False, "", True),
    ".": (".", ".", False, "", False),
    "/": ("/", "/", False, "", False),
    ";": (";", ";", True, "", False),
    "?": ("?", "&", True, "=", False),
    "&": ("&", "&", True, "=", False),
}


def _expand(template: str, values: dict[str, str]) -> str:
    import re
    from urllib.parse import quote

    def put(m):
        first, sep, named, empty, reserved = _TEMPLATE[m[1]]
        out = []
        for spec in m[2].split(","):
            name, _, cut = spec.rstrip("*").partition(":")
            value = values.get(name)
            if value is not None:
                value = quote(value[: int(cut)] if cut.isdigit() else value, safe=":/?#[]@!$&'()*+,;=-._~" if reserved else "-._~")
                out.append((f"{name}={value}" if value else name + empty) if named else value)
        return first + sep.join(out) if out else ""

    return re.sub(r"\{([+#./;?&]?)([^{}]+)\}", put, template)


def expand_template(template: Column, values: Column) -> Column:
    """A URL template (RFC 6570) filled from a map of texts; names without a value vanish."""
    import pandas as pd

    def run(t, v):
        return pd.Series([None if a is None else _expand(a, dict(b if b is not None else {})) for a, b in zip(t, v, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(template, values)


# References (RFC 3986, section 5).

_PLAIN = re.compile(_PARTS, re.S)


def _without_dots(path: str) -> str:
    out: list[str] = []
    steps = path.split("/")
    for k, step in enumerate(steps):
        last = k == len(steps) - 1
        if step == "..":
            if out and out != [""]:
                out.pop()
            out += [""] if last else []
        elif step == ".":
            out += [""] if last else []
        else:
            out.append(step)
    return "/" if out == [""] and path.startswith("/") else "/".join(out)


def absolute(base: str, url: str) -> str:
    """What a reference in a page means; any two strings do. The same as :func:`absolute_to`, for code that parses markup."""
    b, r = _PLAIN.match(base), _PLAIN.match(url)
    if b is None or r is None or b[1] is None:
        return url
    if r[1] is not None or url.startswith("//"):
        authority, path, query = r[2], _without_dots(r[3]), r[4]
    elif r[3]:
        authority, query = b[2], r[4]
        folder = b[3][: b[3].rfind("/") + 1] or ("/" if b[2] is not None else "")
        path = _without_dots(r[3] if r[3].startswith("/") else folder + r[3])
    else:
        authority, path, query = b[2], b[3], r[4] if r[4] is not None else b[4]
    scheme = r[1] if r[1] is not None else b[1]
    tail = ("" if query is None else f"?{query}") + ("" if r[5] is None else f"#{r[5]}")
    return f"{scheme}:{'' if authority is None else f'//{authority}'}{path}{tail}"


def without_dots(path: Column) -> Column:
    """A path without its . and .. steps, as a fold over the steps; those above the root are dropped."""
    steps = F.split(path, "/")
    nothing = F.array().cast("array<string>")
    end = F.element_at(steps, -1)

    def step(acc: Column, s: Column) -> Column:
        kept = F.when((F.size(acc) == 0) | ((F.size(acc) == 1) & (F.get(acc, F.lit(0)) == "")), acc).otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when(s == "..", kept).when(s == ".", acc).otherwise(F.array_append(acc, s))

    folded = F.aggregate(steps, nothing, step)
    out = F.array_join(F.when(end.isin(".", ".."), F.array_append(folded, F.lit(""))).otherwise(folded), "/")
    return F.when((out == "") & path.startswith("/"), "/").otherwise(out)


def absolute_to(url: Column, base: Column) -> Column:
    """A reference resolved against the URL it stands in; a base without a scheme leaves it as it is. Never fails."""
    has = lambda c, name: {"protocol": c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "authority": c.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), "query": c.rlike(r"^[^?#]*\?"), "fragment": F.contains(c, F.lit("#"))}[name]
    own, path = has(url, "protocol") | has(url, "authority"), part(url, "path")
    folder = F.regexp_extract(part(base, "path"), "(?s)^(.*/)", 1)
    folder = F.when((folder == "") & has(base, "authority"), "/").otherwise(folder)
    merged = F.when(own | path.startswith("/"), path).otherwise(F.concat(folder, path))
    stays = ~own & (path == "")
    query = F.when(has(url, "query"), F.concat(F.lit("?"), part(url, "query"))).when(stays & has(base, "query"), F.concat(F.lit("?"), part(base, "query"))).otherwise("")
    scheme = F.when(has(url, "protocol"), part(url, "protocol")).otherwise(part(base, "protocol"))
    side = F.when(own, F.when(has(url, "authority"), F.concat(F.lit("//"), part(url, "authority"))).otherwise("")).when(has(base, "authority"), F.concat(F.lit("//"), part(base, "authority"))).otherwise("")
    fragment = F.when(has(url, "fragment"), F.concat(F.lit("#"), F.regexp_extract(url, "(?s)#(.*)$", 1))).otherwise("")
    return F.when(has(base, "protocol"), F.concat(scheme, F.lit(":"), side, F.when(stays, part(base, "path")).otherwise(without_dots(merged)), query, fragment)).otherwise(url)


def relative_to(url: Column, base: Column) -> Column:
    """The shortest reference by folders that means a URL in another one; the URL itself where scheme or authority differ."""
    same = (part(url, "protocol") == part(base, "protocol")) & (part(url, "authority") == part(base, "authority")) & part(url, "path").startswith("/") & part(base, "path").startswith("/")
    folders = lambda c: F.split(F.regexp_extract(part(c, "path"), "(?s)^/(.*/)?[^/]*$", 1), "(?<=/)")
    mine, theirs = folders(url), folders(base)
    equal = F.zip_with(mine, theirs, lambda a, b: F.coalesce((a == b) & (a != ""), F.lit(False)))
    shared = F.coalesce(F.nullif(F.array_position(equal, F.lit(False)), F.lit(0)), F.size(equal).cast("long") + 1) - 1
    up = F.repeat(F.lit("../"), F.greatest(F.size(F.filter(theirs, lambda x: x != "")) - shared, F.lit(0)).cast("int"))
    rest = F.concat(F.array_join(F.slice(mine, (shared + 1).cast("int"), F.size(mine)), ""), F.regexp_extract(part(url, "path"), "(?s)([^/]*)$", 1))
    path = F.concat(up, rest)
    safe = F.when((path == "") | path.rlike("^[^/]*:") | path.startswith("/"), F.concat(F.lit("./"), path)).otherwise(path)
    return F.when(same, F.concat(safe, F.regexp_extract(url, "(?s)^[^?#]*(.*)$", 1))).otherwise(url)
