"""Scalar rules over names, paths, messages and scores, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import VIRTUAL_REPO

# Conventional commit types.
COMMIT_TYPES = "feat fix docs style refactor perf test build ci chore revert".split()
# Phrases that mark a decision.
DECISION_PHRASES = ("because", "decided", "trade-off", "tradeoff", "rationale", "we chose")
# Groups of synonyms for search.
SYNONYMS = (
    ("login", "signin", "auth", "authenticate", "authentication"),
    ("logout", "signout", "deauthenticate"),
    ("paginate", "pagination", "paging", "cursor", "offset", "page"),
    ("delete", "remove", "destroy"),
    ("create", "add", "insert"),
    ("update", "edit", "modify"),
    ("list", "fetch", "get", "find"),
)
# Code languages by extension.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "rs": "rust", "go": "go", "java": "java"}


def node_id(repo: Column, path: Column, kind: Column, qualified_name: Column) -> Column:
    """Content-addressed id: depends on nothing but its parts; 16 bytes as hex."""
    nul = F.lit("\x00")
    return F.substring(F.sha2(F.concat(repo, nul, path, nul, kind, nul, qualified_name), 256), 1, 32)


def ref_node_id(kind: Column, external_id: Column) -> Column:
    """The same id from any repository."""
    return F.substring(F.sha2(F.concat(kind, F.lit("\x00"), external_id), 256), 1, 32)


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(*(F.when(ext == e, F.lit(lang)) for e, lang in LANGUAGES.items()))


def route_path(url: Column) -> Column:
    """Canonical route path: no scheme, host, query, fragment or trailing slash; lower case; parameters as :id."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    parts = F.filter(F.split(bare, "/"), lambda s: s != "")
    canon = F.transform(parts, lambda s: F.when(s.rlike(r"^(:.+|\$.+|\{.+\}|\[.+\])$"), F.lit(":id")).otherwise(F.lower(s)))
    return F.concat(F.lit("/"), F.array_join(canon, "/"))


def route_key(method: Column, url: Column) -> Column:
    verb = F.upper(F.trim(method))
    return F.concat(F.when(verb == "FETCH", F.lit("GET")).otherwise(verb), F.lit(" "), route_path(url))


def route_key_of(external_id: Column) -> Column:
    """``METHOD /path`` of a route node's or a call's external id; null for others. Fetches are gets."""
    method, path = (F.regexp_extract(external_id, r"^(?:__route__|__api_call__)(.*?)__(.*)$", i) for i in (1, 2))
    verb = F.when(F.upper(method) == "FETCH", F.lit("GET")).otherwise(F.upper(method))
    return F.when(external_id.rlike(r"^(__route__|__api_call__).*?__"), F.concat(verb, F.lit(" "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))


def is_real_repo(repo: Column) -> Column:
    return repo.isNotNull() & (repo != "") & (repo != VIRTUAL_REPO)


def path_separators(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_display(raw: Column) -> Column:
    """Raw path bytes as text for reading; bytes that are no UTF-8 are replaced, so it is no key."""
    return F.make_valid_utf8(raw.cast("string"))


def event_name(external_id: Column, qualified_name: Column | None = None, name: Column | None = None) -> Column:
    """What follows the last double underscore, in lower case."""
    found = F.coalesce(*(c for c in (external_id, qualified_name, name) if c is not None))
    return F.lower(F.substring_index(found, "__", -1))


def family_match(event: Column, family: Column) -> Column:
    bare = F.lower(F.regexp_replace(family, r"\.\*$", ""))
    return (event == bare) | event.startswith(F.concat(bare, F.lit(".")))


def short_name(qualified_name: Column) -> Column:
    return F.lower(F.substring_index(F.substring_index(qualified_name, "::", -1), "__", -1))


def topology_part(text: Column, fallback: str = "unknown") -> Column:
    """Lower-case letters, digits, dot, dash and colon; every other run is one underscore."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9.:-]+", "_"), r"^_+|_+$", "")
    return F.when(x == "", F.lit(fallback)).otherwise(x)


def node_label(kind: Column, name: Column, external_id: Column) -> Column:
    tail = F.substring_index(external_id, "__", -1)
    return F.when(kind.isin("topic", "queue", "event", "stream", "subject"), F.concat(kind, F.lit(":"), tail)).when(kind == "shared_symbol", F.concat(F.lit("shared:"), tail)).when(kind == "route", tail).otherwise(name)


def package_root(spec: Column) -> Column:
    """The package of an import; null for relative ones."""
    scoped = F.regexp_extract(spec, r"^(@[^/]+/[^/]+)", 1)
    plain = F.regexp_extract(spec, r"^([^@./][^/]*)", 1)
    return F.when(scoped != "", scoped).when(plain != "", plain)


def identifier_text(text: Column) -> Column:
    """Blanks at every boundary inside identifiers; the steps run in engines without lookaround too."""
    steps = ((r"([\p{Ll}])([\p{Lu}])", "$1 $2"), (r"([\p{Lu}])([\p{Lu}][\p{Ll}])", "$1 $2"), (r"([\p{L}])([0-9])", "$1 $2"), (r"([0-9])([\p{L}])", "$1 $2"))
    return reduce(lambda c, s: F.regexp_replace(c, *s), steps, text)


def tokens(text: Column, max_bytes: int = 80) -> Column:
    """Lower-case identifier tokens in order; overlong ones are dropped."""
    found = F.split(F.lower(F.regexp_replace(identifier_text(F.coalesce(text, F.lit(""))), r"[^\p{L}0-9]+", " ")), " ")
    return F.filter(found, lambda t: (t != "") & (F.octet_length(t) <= max_bytes))


def first_token(text: Column) -> Column:
    return F.get(tokens(text), F.lit(0))


def commit_class(message: Column) -> Column:
    """Conventional type of the first line, or null."""
    line = F.substring_index(message, "\n", 1)
    t = F.lower(F.regexp_extract(line, r"(?i)^\s*(" + "|".join(COMMIT_TYPES) + r")(\([^)]*\))?!?:", 1))
    return F.when(t != "", t)


def pr_number(message: Column) -> Column:
    line = F.substring_index(message, "\n", 1)
    merge, squash = (F.regexp_extract(line, p, 1) for p in (r"^Merge pull request #([0-9]+)", r"\(#([0-9]+)\)"))
    return F.coalesce(F.when(merge != "", merge), F.when(squash != "", squash)).cast("int")


def decision_signal(message: Column) -> Column:
    low = F.lower(message)
    return reduce(lambda a, b: a | b, (low.contains(p) for p in DECISION_PHRASES))


def redact_email(email: Column, key: str) -> Column:
    return F.concat(F.substring(F.sha2(F.concat(F.lit(key), email), 256), 1, 16), F.lit("@redacted"))


def confidence_band(conf: Column) -> Column:
    return F.when(conf >= 900, "strong").when(conf >= 700, "medium").otherwise("weak")


def combine_confidence(a: Column, b: Column) -> Column:
    """Thousandths multiply and truncate; a missing one is trusted."""
    return F.coalesce(F.floor(a.cast("long") * b / 1000).cast("int"), a, b)


def passes(conf: Column, least: int | None) -> Column:
    """Missing confidence passes every threshold."""
    return F.lit(True) if least is None else conf.isNull() | (conf >= least)


def age_days(then: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (now - then) / 86400.0)


def decay(age: Column, tau: float) -> Column:
    return F.exp(-age / tau)


def sanitize_cell(text: Column) -> Column:
    """Safe inside a markdown table."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|"), ("`", "\\`")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, r"[\r\n\t ]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def duration_seconds(text: Column) -> Column:
    n, unit = F.regexp_extract(text, r"^([0-9]+)([smhd])$", 1), F.regexp_extract(text, r"^([0-9]+)([smhd])$", 2)
    return F.when(n != "", n.cast("long") * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).otherwise(86400))


def env_name(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


# The patterns of test, mock and program files and the literals that mirror nothing.
def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(__tests__|tests?|spec)/|\.(test|spec)\.[a-z]+$|_test\.(go|py)$|(^|/)test_[^/]*\.py$")


def is_mock_path(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(__mocks__|mocks?|fixtures?|stubs?)/|\.mock\.|\.stub\.")


def is_root_path(path: Column) -> Column:
    return F.lower(path).rlike(r"/bin/|/main\.(rs|ts)$|/app\.(ts|js)$|/server\.[a-z]+$|/index\.[a-z]+$")


def mirror_is_specific(literal: Column) -> Column:
    """Literals too generic to mirror anything are rejected."""
    return (F.length(literal) >= 3) & ~F.lower(literal).isin("true", "false", "null", "none", "default", "unknown", "name", "type", "value", "key", "id")
