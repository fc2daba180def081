"""Column functions on text: identifier terms, keys, titles, paths, links, checks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: letters and digits at both ends, and what identifiers have between.
TOKEN = r"[A-Za-z0-9](?:[A-Za-z0-9_./-]*[A-Za-z0-9])?"
MAX_TERMS = 12


def identifier_terms(text: Column, most: int = MAX_TERMS) -> Column:
    """Tokens that look like identifiers (punctuated, with a digit, or camel case), lower-cased, first places kept."""
    camel = lambda t: (F.substr(t, F.lit(2)) != F.lower(F.substr(t, F.lit(2)))) & (t != F.upper(t))
    found = F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: t.rlike("[_./-]|[0-9]") | camel(t))
    return F.slice(F.array_distinct(F.transform(found, F.lower)), 1, most)


def simple_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without stemming or stop words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def entity_key(name: Column) -> Column:
    """`RefundWorker`, `refund_worker` and `Refund Worker` all become refund-worker."""
    parts = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "-")
    return F.trim(F.regexp_replace(F.lower(parts), "[^a-z0-9]+", "-"), F.lit("-"))


def names_key(question_key: Column, key: Column) -> Column:
    """Whether a key of at least 4 characters is a run of whole parts of the question's key."""
    return (F.length(key) >= 4) & F.contains(F.concat(F.lit("-"), question_key, F.lit("-")), F.concat(F.lit("-"), key, F.lit("-")))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def title(text: Column, most: int = 60) -> Column:
    """One line of at most `most` characters, an ellipsis in place of the rest."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.left(flat, F.lit(most - 1))), F.lit("…"))).otherwise(flat)


#: Control and direction characters (fixed values).
CONTROL = r"[\x00-\x1F\x7F-\x9F\u200B-\u200F\u202A-\u202E\u2066-\u2069]"


def plain(text: Column, most: int) -> Column:
    """Control and direction characters and white space become single blanks; cut to `most`."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, CONTROL, " "), r"(?U)\s+", " "))
    return F.when(F.length(bare) > most, F.concat(F.left(bare, F.lit(most - 1)), F.lit("…"))).otherwise(bare)


def clean(text: Column, most: int) -> Column:
    """Without control and direction characters (line ends and tabs stay) and outer white space; what is cut off shows as an ellipsis. Null is empty."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?![\\t\\n]){CONTROL}", " "), r"(?U)^\s+|\s+\z", "")
    return F.when(F.length(bare) > most, F.concat(F.left(bare, F.lit(most - 1)), F.lit("…"))).otherwise(bare)


def safe_url(url: Column, most: int = 2048) -> Column:
    """The URL if it is http or https in any case, has a host, no blank or control character, and at most `most` characters; else null."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.when((F.length(url) <= most) & ~url.rlike(f"{CONTROL}| ") & F.lower(url).rlike("^https?://") & host.isNotNull(), url)


def strict_url(url: Column) -> Column:
    """The URL if it is https with a host and without user info, else null."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.when(url.startswith("https://") & host.isNotNull() & F.try_parse_url(url, F.lit("USERINFO")).isNull(), url)


def host_allowed(url: Column, hosts: list[str]) -> Column:
    """Whether an https URL's host is listed, or one label below a listed `*.suffix`."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    rule = "|".join(r"[^.]+\." + re.escape(h[2:]) if h.startswith("*.") else re.escape(h) for h in hosts)
    return F.coalesce(strict_url(url).isNotNull() & host.rlike(f"^(?:{rule})$"), F.lit(False))


def correlation_id(raw: Column) -> Column:
    """Null, the id itself, or `invalid`."""
    return F.when(raw.isNull() | (raw == ""), F.lit(None)).when(raw.rlike("^[A-Za-z0-9._-]{1,64}$"), raw).otherwise("invalid")


def uuid_or_null(raw: Column) -> Column:
    """The canonical form of a UUID with or without hyphens, braces, and `urn:` and `uuid:` before it; null for anything else."""
    bare = F.replace(F.replace(raw, F.lit("urn:")), F.lit("uuid:"))
    digits = F.lower(F.replace(F.trim(bare, F.lit("{}")), F.lit("-")))
    return F.when(digits.rlike(r"^[0-9a-f]{32}\z"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def user_key(oid: Column) -> Column:
    return F.left(F.sha2(F.lower(oid), 256), F.lit(32))


def args_hash(canonical_json: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.left(F.sha2(canonical_json, 256), F.lit(16)))


def has_offset(iso: Column) -> Column:
    """Whether an ISO timestamp parses and names its offset."""
    return F.coalesce(iso.rlike(r"(Z|[+-]\d\d:?\d\d)$") & F.try_to_timestamp(iso).isNotNull(), F.lit(False))


def link_targets(markdown: Column) -> Column:
    """Targets of Markdown links outside code fences, without URLs, anchors and fragments."""
    bare = F.regexp_replace(markdown, r"(?s)```.*?(```|$)", "")
    found = F.transform(F.regexp_extract_all(bare, F.lit(r"\]\(([^)\s]+)\)"), F.lit(1)), lambda x: F.regexp_replace(x, "#.*$", ""))
    return F.array_distinct(F.filter(found, lambda x: (x != "") & ~x.rlike("^[a-z][a-z0-9+.-]*:")))


def glob_regex(pattern: str) -> str:
    """A whole-path pattern: `**/` any folders or none, `**` anything, `*` and `?` within a name."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", pattern)
    rule = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^(?:" + "".join(rule.get(p, re.escape(p)) for p in parts) + ")$"


def selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Matches any include (or there is none) and no exclude."""
    some = lambda globs: F.lit(False) if not globs else path.rlike("|".join(map(glob_regex, globs)))
    return (some(include) if include else F.lit(True)) & ~some(exclude)


#: Extensions of each media type of a stored document (fixed values).
MEDIA_TYPES = {"text/markdown": (".md", ".markdown"), "text/plain": (".txt",), "text/csv": (".csv",), "application/json": (".json",)}


def artifact_problem(name: Column, media_type: Column, size: Column, types: dict[str, tuple[str, ...]] = MEDIA_TYPES, most: int = 1 << 20) -> Column:
    """Why a document can't be stored, or null. `types`: extensions by media type."""
    pairs = F.create_map(*[x for m, e in sorted(types.items()) for x in (F.lit(m), F.array(*[F.lit(v) for v in e]))])
    own = F.coalesce(name, F.lit(""))
    return (
        F.when(~F.coalesce(media_type.isin(*types), F.lit(False)), "media type")
        .when(~own.rlike("^[A-Za-z0-9][A-Za-z0-9._ -]{0,99}$") | F.contains(own, F.lit("..")), "name")
        .when(~F.exists(F.try_element_at(pairs, media_type), lambda e: F.endswith(F.lower(own), e)), "extension")
        .when(size <= 0, "empty")
        .when(size > most, "too large")
    )


def jwt_claims(token: Column, schema: str) -> Column:
    """The claims of a token, not verified; null where they can't be read."""
    body = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.rpad(body, F.ceil(F.length(body) / 4) * 4, F.lit("="))
    return F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), schema)


def cut_text(text: Column, most: int) -> Column:
    """{text, truncated}: at most so many characters, and whether there were more."""
    return F.struct(F.left(text, F.lit(most)).alias("text"), (F.length(text) > most).alias("truncated"))


def level_rank(level: Column, levels: list[str]) -> Column:
    """The place of a level among ordered ones, from 0; null for an unknown one."""
    at = F.array_position(F.array(*[F.lit(x) for x in levels]), level)
    return F.when(at > 0, at - 1)


def vector_literal(v: Column) -> Column:
    """[x,y,...] with at most seven significant digits a number."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.7g", x.cast("double"))), ","), F.lit("]"))


def clean_comments(comments: Column, most: int = 50, length: int = 1000) -> Column:
    """Comments (array of struct<start, end, text>) that have a text and a range, trimmed and cut, by start, then end, the first `most`."""
    cut = F.transform(comments, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.left(F.regexp_replace(c["text"], r"(?U)^\s+|\s+$", ""), F.lit(length)).alias("text")))
    good = F.filter(cut, lambda c: (c["text"] != "") & (c["start"] >= 1) & (c["end"] >= c["start"]))
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"]).cast("int")
    return F.slice(F.array_sort(good, order), 1, most)


def frontmatter(text: Column) -> Column:
    """{meta, body}: what stands between two lines of --- at the very beginning (null if nothing does), and the rest."""
    pattern = r"(?s)\A---\r?\n(.*?)(?:\A|(?<=\n))---[ \t]*(?:\r?\n|\z)"
    has = text.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(text, pattern, 1)).alias("meta"), F.when(has, F.regexp_replace(text, pattern, "")).otherwise(text).alias("body"))


def section_under(body: Column, heading: str) -> Column:
    """What stands under a heading of the second level, up to the next of that level or above."""
    return F.trim(F.regexp_extract(body, rf"(?ms)^## {re.escape(heading)}[ \t]*$(.*?)(?=^#{{1,2}} |\z)", 1), F.lit(" \t\r\n"))


def named_value(json: Column, field: str) -> Column:
    """A JSON field that is an object with a name or a value, or a string: whichever it has."""
    at = lambda path: F.get_json_object(json, f"$.{field}{path}")
    return F.when(F.get_json_object(json, f"$.{field}").startswith("{"), F.coalesce(at(".name"), at(".value"))).otherwise(at(""))


def json_inside(text: Column, schema: str) -> Column:
    """The JSON object from the first { to the last } of a text; null where it can't be read."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def tool_payload(response: Column) -> Column:
    """The object that a tool's response (JSON) carries, as a VARIANT: its structuredContent, or what that has in its only field `result`; else the JSON in the first
    text of its content; else the response itself. Null where that is no object, and for JSON that can't be read."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    is_object = lambda v: kind(v).startswith("OBJECT")
    at = lambda v, path: F.try_variant_get(v, path, "variant")
    whole = F.try_parse_json(response)
    structured = at(whole, "$.structuredContent")
    inner = at(structured, "$.result")
    alone = F.size(F.map_keys(F.try_variant_get(structured, "$", "map<string,variant>"))) == 1
    content = at(whole, "$.content")
    texts = F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda item: kind(at(item, "$.text")) == "STRING")
    said = F.try_parse_json(F.try_variant_get(F.get(texts, F.lit(0)), "$.text", "string"))
    return (
        F.when(is_object(structured), F.when(is_object(inner) & alone, inner).otherwise(structured))
        .when(kind(content).startswith("ARRAY"), F.when(is_object(said), said))
        .when(is_object(whole), whole)
    )


def bucket_location(location: Column) -> Column:
    """{bucket, prefix} of gs://bucket/prefix; the prefix is empty or ends with a slash; null if it is no such location."""
    rest = F.regexp_extract(location, "^gs://[^/]+/+(.*)$", 1)
    return F.when(location.rlike("^gs://[^/]+"), F.struct(F.regexp_extract(location, "^gs://([^/]+)", 1).alias("bucket"), F.when((rest == "") | rest.endswith("/"), rest).otherwise(F.concat(rest, F.lit("/"))).alias("prefix")))


def deep_link(provider: Column, location: Column, commit: Column, path: Column) -> Column:
    """Where a file at a commit is shown by its provider; null for local repositories and unknown providers."""
    host = F.regexp_extract(location, "^(https://[^/]+)", 1)
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(location, "^https://[^/]+", ""), r"\.git/*$", ""), "/"), lambda x: x != "")
    nth = lambda k: F.get(parts, F.size(parts) - k)
    # url_encode is that of forms: a path keeps its slashes and ~, and * is escaped.
    quoted = F.url_encode(path)
    for form, of_paths in (("%2F", "/"), ("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        quoted = F.replace(quoted, F.lit(form), F.lit(of_paths))
    repo = F.concat_ws("/", host, nth(2), nth(1))
    root = F.concat_ws("/", host, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 3, F.lit(0))), "/"))
    return F.when(location.startswith("https://") & (F.size(parts) >= 2), F.when(provider == "github", F.concat_ws("/", repo, F.lit("blob"), commit, quoted)).when(provider == "bitbucket-cloud", F.concat_ws("/", repo, F.lit("src"), commit, quoted)).when(
        (provider == "bitbucket-dc") & (nth(3) == "scm"), F.concat(F.concat_ws("/", F.rtrim(root, F.lit("/")), F.lit("projects"), F.upper(nth(2)), F.lit("repos"), nth(1), F.lit("browse"), quoted), F.lit("?at="), commit)))


def selection_fingerprint(include: Column, exclude: Column) -> Column:
    """Sixteen hex digits of the globs; another fingerprint means a full read."""
    return F.left(F.sha2(F.to_json(F.array(include, exclude)), 256), F.lit(16))


def resolved_target(path: Column, ref: Column) -> Column:
    """The path that a link in the document `path` leads to, from the root; null for URLs, anchors and what lies above the root."""
    bare = F.regexp_replace(ref, "(?s)#.*$", "")
    whole = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), bare))
    up = lambda done: F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", up(done)).otherwise(F.concat(done, F.array(part)))
    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    return F.when((bare != "") & ~F.contains(bare, F.lit("://")) & ~bare.startswith("mailto:"), F.array_join(parts, "/"))
