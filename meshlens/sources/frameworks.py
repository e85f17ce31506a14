"""Routes, entities and topics that files declare by the conventions of common frameworks.

Each rule is a pattern over a file's text or path, so a scan is one pass of built-in functions
without a shuffle. Line comments are taken out first where they start a line; a declaration whose
name is computed gives nothing. A file may match several frameworks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_Q = "[\"'`]"
_NAME = "([^\"'`]+)"
_SCRIPT, _PYTHON = r"\.[cm]?[jt]sx?$", r"\.py$"
#: (framework, fact, files, text that must occur, pattern); the last group of a pattern is the name, one before it a verb.
RULES = (
    ("fastapi", "route", _PYTHON, "fastapi", rf"(?m)^[ \t]*@\w+\.(get|post|put|patch|delete|head|options)\([ \t\n]*(?:path[ \t]*=[ \t]*)?{_Q}([^\"'`]*){_Q}"),
    ("flask", "route", _PYTHON, "flask", rf"(?m)^[ \t]*@\w+\.(route)\([ \t\n]*{_Q}{_NAME}{_Q}"),
    ("express", "route", _SCRIPT, "express", rf"\b(?:app|router)\.(get|post|put|patch|delete|all)\([ \t\n]*{_Q}(/[^\"'`]*){_Q}"),
    ("kafka", "publishes", _PYTHON, "kafka", rf"\bproducer\.(?:send|produce|send_and_wait)\([ \t\n]*{_Q}{_NAME}{_Q}"),
    ("kafka", "consumes", _PYTHON, "kafka", rf"\b(?:AIO)?KafkaConsumer\([ \t\n]*{_Q}{_NAME}{_Q}"),
    ("kafka", "consumes", _PYTHON, "kafka", rf"\.subscribe\([ \t\n]*\[?[ \t\n]*{_Q}{_NAME}{_Q}"),
    ("prisma", "entity", r"\.prisma$", "model", r"(?m)^[ \t]*model[ \t]+(\w+)[ \t]*\{"),
    ("prisma", "enum", r"\.prisma$", "enum", r"(?m)^[ \t]*enum[ \t]+(\w+)[ \t]*\{"),
    ("mongoose", "entity", _SCRIPT, "mongoose", rf"\bmodel(?:<[^>(]*>)?\([ \t\n]*{_Q}{_NAME}{_Q}"),
    ("mongoose", "collection", _SCRIPT, "mongoose", rf"\bcollection[ \t]*:[ \t]*{_Q}{_NAME}{_Q}"),
    ("typeorm", "entity", _SCRIPT, "typeorm", rf"@Entity\([ \t\n]*(?:\{{[ \t\n]*name[ \t]*:[ \t]*)?{_Q}{_NAME}{_Q}"),
    ("drizzle", "entity", _SCRIPT, "drizzle-orm", rf"\b(?:pg|mysql|sqlite)Table\([ \t\n]*{_Q}{_NAME}{_Q}"),
    ("sqlalchemy", "entity", _PYTHON, "sqlalchemy", rf"(?m)^[ \t]*__tablename__[ \t]*=[ \t]*{_Q}{_NAME}{_Q}"),
)
#: Rules whose pattern has a verb before the name.
_VERBS = frozenset(("fastapi", "flask", "express"))
FACT = "struct<framework:string,fact:string,name:string>"


def _next_route(path: Column, text: Column) -> Column:
    """Facts of a file that is a route by its place: app/**/route.ts, one a verb it exports, and pages/api/**."""
    app = F.regexp_extract(path, rf"(?:^|/)app((?:/[^/]+)*)/route{_SCRIPT}", 1)
    is_app = path.rlike(rf"(^|/)app(/[^/]+)*/route{_SCRIPT}")
    pages = F.regexp_extract(path, rf"(?:^|/)pages(/api(?:/[^/]+)*?)(?:/index)?{_SCRIPT}", 1)
    # groups in parentheses are no part of a path; [id] is a parameter, [...rest] the rest
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"/\([^/)]*\)", ""), r"\[\[?\.\.\.([^\]]+)\]\]?", "*$1"), r"\[([^\]]+)\]", ":$1")
    whole = lambda x: F.when(clean(x) == "", "/").otherwise(clean(x))
    verbs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*export[ \t]+(?:async[ \t]+)?(?:function|const)[ \t]+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"), F.lit(1)))
    fact = lambda name: F.struct(F.lit("nextjs").alias("framework"), F.lit("route").alias("fact"), name.alias("name"))
    return F.when(is_app, F.transform(verbs, lambda v: fact(F.concat(v, F.lit(" "), whole(app))))).when(pages != "", F.array(fact(F.concat(F.lit("ANY "), whole(pages))))).otherwise(F.array().cast(f"array<{FACT}>"))


def framework_facts(files: DataFrame) -> DataFrame:
    """(repo, file_path, framework, fact, name), distinct within a file. Names of routes are ``VERB /path``, ANY where the verb is not told.

    Files without a path or text, and columns other than repo, file_path and content, play no part.
    """
    f = files.where("file_path is not null and content is not null").select("repo", "file_path", F.regexp_replace("content", r"(?m)^[ \t]*(?://|#).*$", "").alias("text"))
    path, text, none = F.col("file_path"), F.col("text"), F.array().cast(f"array<{FACT}>")

    def facts(framework: str, fact: str, where: str, needs: str, pattern: str) -> Column:
        if framework in _VERBS:
            pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("v"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("n"))
            names = F.transform(pairs, lambda p: F.concat(F.when(F.lower(p["v"]).isin("route", "all"), "ANY").otherwise(F.upper(p["v"])), F.lit(" "), F.when(p["n"] == "", "/").otherwise(p["n"])))
        else:
            names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        made = F.transform(names, lambda n: F.struct(F.lit(framework).alias("framework"), F.lit(fact).alias("fact"), n.alias("name")))
        return F.when(path.rlike(where) & F.lower(text).contains(needs), made).otherwise(none)

    found = F.array_distinct(F.concat(_next_route(path, text), *(facts(*rule) for rule in RULES)))
    return f.select("repo", "file_path", F.explode(found).alias("x")).select("repo", "file_path", "x.framework", "x.fact", "x.name")
