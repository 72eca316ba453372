"""Scalar functions as Column expressions: they stay in the JVM and inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the domains, by the part of a project's name that tells them.
DOMAIN_LABELS = {"dept-bcc": "存款", "loan-bcc": "贷款", "comm-bcc": "公共", "sett-bcc": "结算"}
OTHER = "其他"
# Business kinds by the part of a service's name that tells them, in order.
BIZ_KINDS = {"hotspot": "热点账户", "batch": "批量", "online": "联机"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordered(c: Column | str, rules: dict[str, str], other: str | None) -> Column:
    """The label of the first rule whose text is part of c, in any case."""
    out = None
    for part, label in rules.items():
        test = F.lower(col(c)).contains(part)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.lit(other))


def domain_label(project: Column | str) -> Column:
    return ordered(project, DOMAIN_LABELS, OTHER)


def biz_kind(service: Column | str) -> Column:
    return ordered(service, BIZ_KINDS, None)


def domain_key(project: Column | str, package: Column | str) -> Column:
    """From a project named x-parent or ccbs-x-..., else the fourth part of a package, else platform."""
    p, parts = col(project), F.split(col(package), r"\.")
    parent, module = F.regexp_extract(p, r"^(\w+)-parent$", 1), F.regexp_extract(p, r"^ccbs-(\w+)-", 1)
    fourth = F.when(F.size(parts) >= 4, parts[3])
    return F.coalesce(F.nullif(parent, F.lit("")), F.nullif(module, F.lit("")), F.nullif(fourth, F.lit("")), F.lit("platform"))


# Parts of a path that tell a table's domain, in order, with / for every separator.
TABLE_DOMAINS = {
    "deposit": ["/dept/", "/deptbase/", "/ltdept", "/itdept", "/kdp"],
    "loan": ["/loan/", "/loanbase/", "/lnacct", "/lnctrct", "/lntran", "/kln"],
    "settlement": ["/sett/", "/settbase/", "/stt", "/kst"],
}
# Whole names in a path or module that tell public tables.
PUBLIC_NAMES = ["comm", "common"]
PUBLIC_MODULES = ["comm", "unvr", "stmt", "medu", "inbu"]
PUBLIC_PATHS = ["common", "comm", "unvr", "apcptable", "sysdbtable", "syscommfieldtable", "stmt"]
# Business projects; only loan is a table's domain by the same name.
PROJECTS = ["loan", "dept", "comm", "sett", "dict"]


def table_domain(module: Column | str, package: Column | str, path: Column | str) -> Column:
    """Domain of a table: its module where that is a loan project or, not blank, none of the
    business projects; else what its package tells, then its path; public names; the package's
    fourth part; public."""
    slashes = lambda c: F.translate(F.lower(F.coalesce(col(c), F.lit(""))), "\\.-_", "////")
    named = lambda text, names: F.rlike(text, F.lit(rf"(?:^|/)(?:{'|'.join(names)})(?:/|$)"))
    name, mod, pkg, file = F.lower(trimmed(module)), slashes(module), slashes(package), slashes(path)
    project = F.regexp_extract(name, rf"^(?:({'|'.join(PROJECTS)})-parent$|ccbs-({'|'.join(PROJECTS)})-)", 0)
    by_module = F.when(name == "", None).when(project == "", "platform").when(project.contains("loan"), "loan")

    def told(text: Column) -> Column:
        tests = [F.when(reduce(lambda a, b: a | b, map(text.contains, parts)), domain) for domain, parts in TABLE_DOMAINS.items()]
        return F.coalesce(*tests, F.when(named(text, PUBLIC_NAMES), "public"))

    public = F.when(named(mod, PUBLIC_MODULES) | named(pkg, PUBLIC_PATHS) | named(file, PUBLIC_PATHS), "public")
    fourth = F.get(F.split(F.coalesce(col(package), F.lit("")), r"\."), 3)
    left = F.when(fourth == "loan", "loan").when(fourth.isin(PROJECTS), "public").otherwise("platform")
    return F.coalesce(by_module, told(pkg), told(file), public, left)


def cost(raw: Column | str) -> Column:
    """The first run of digits without commas, else 0."""
    digits = F.regexp_extract(F.regexp_replace(col(raw), ",", ""), r"(\d+)", 1)
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def trimmed(text: Column | str) -> Column:
    """Without blanks and control characters at both ends."""
    return F.btrim(col(text), F.lit("".join(map(chr, range(33)))))


def text_hash(text: Column | str) -> Column:
    return F.sha2(trimmed(text), 256)


def next_round(day: str, name: str) -> Column:
    """An aggregate: day-(largest suffix + 1); malformed names count as none."""
    suffix = F.regexp_extract(name, r"^\d{8}-(\d+)$", 1).try_cast("int")
    return F.concat(F.first(day), F.lit("-"), (F.coalesce(F.max(suffix), F.lit(0)) + 1).cast("string"))


def valid_round(name: Column | str) -> Column:
    n = col(name)
    return F.coalesce((F.trim(n) != "") & (F.char_length(n) <= 20) & ~n.contains(","), F.lit(False))


def location(raw: Column | str) -> Column:
    """Trimmed, without the brackets around it that close at its end, however many, empty as null,
    at most 512 characters."""
    text = F.trim(col(raw))
    pairs = F.least(F.length(F.regexp_extract(text, r"^(\[*)", 1)), F.length(F.regexp_extract(text, r"(\]*)$", 1)))
    inner = F.substring(text, pairs + 1, F.length(text) - 2 * pairs)
    return F.substring(F.nullif(F.trim(inner), F.lit("")), 1, 512)


def location_kind(place: Column | str) -> Column:
    low = F.lower(col(place))
    return F.when(low.startswith("odb:"), "ODB").when(low.startswith("nsql:"), "NSQL").when(low.isNotNull(), "PLATFORM")


def after_colon(place: Column | str) -> Column:
    p = col(place)
    return F.when(F.instr(p, ":") > 0, F.trim(F.substring_index(p, ":", -1))).otherwise(p)


def sql_kind(sql: Column | str) -> Column:
    """Kind of a statement by its first keyword after comments."""
    bare = F.lower(F.regexp_replace(col(sql), r"^(?:\s+|--[^\n]*(?:\n|$)|/\*(?s:.*?)\*/)+", ""))
    word = F.regexp_extract(bare, r"^([a-z]+)", 1)
    insert = F.when(F.rlike(bare, F.lit(r"\bvalues\b")), "INSERT_VALUES").when(F.rlike(bare, F.lit(r"\bselect\b")), "INSERT_SELECT").otherwise("UNKNOWN")
    return F.when(word.isin("select", "with"), "SELECT").when(word == "update", "UPDATE").when(word == "delete", "DELETE").when(word == "insert", insert).otherwise("UNKNOWN")


def placeholders(sql: Column | str) -> Column:
    """#x#, ${x} and :x (but not ::type) become ?."""
    out = F.regexp_replace(col(sql), r"#\w+#", "?")
    out = F.regexp_replace(out, r"\$\{\w+\}", "?")
    return F.regexp_replace(out, r"(?<!:):[A-Za-z_]\w*", "?")


def table_names(sql: Column | str) -> Column:
    """Names after FROM, JOIN, INTO and UPDATE, lower-cased, without schema, each once, comma-joined."""
    found = F.regexp_extract_all(F.lower(col(sql)), F.lit(r"\b(?:from|join|into|update)\s+([a-z_][\w.]*)"), F.lit(1))
    return F.array_join(F.array_distinct(F.transform(found, lambda x: F.substring_index(x, ".", -1))), ",")


def share_percent(part: Column, whole: Column) -> Column:
    """Percent with one decimal, halves up; 0.0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.floor(part * 1000.0 / whole + 0.5) / 10.0)


def person_type(email: Column | str, alias_type: Column | str) -> Column:
    vendor = F.rlike(F.lower(F.substring_index(col(email), "@", 1)), F.lit("^[ct]-"))
    return F.coalesce(col(alias_type), F.when(vendor, "VENDOR").otherwise("STAFF"))


def ellipsis(text: Column | str, most: int) -> Column:
    t = col(text)
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def first_nonblank(*columns: Column | str) -> Column:
    return F.coalesce(*(F.when(F.trim(col(c)) != "", col(c)) for c in columns))


def log_line(line: Column | str) -> Column:
    """(ts, named, sql) of '[ts]...->[named] [sql]' anywhere in a line, the first brackets that close;
    nulls where there is none."""
    pattern = r"(?s)\[([^\]]+)\].*?->\s*\[([^\]]+)\]\s*\[(.+?)\]"
    part = lambda k: F.nullif(F.regexp_extract(col(line), pattern, k), F.lit(""))
    return F.struct(part(1).alias("ts"), part(2).alias("named"), part(3).alias("sql"))


def log_time(ts: Column | str, otherwise: Column) -> Column:
    """With an optional fraction; what can't be read is the import's time."""
    whole = F.regexp_replace(col(ts), r"\.\d{1,3}$", "")
    return F.coalesce(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HH:mm:ss")), otherwise)


def rating(failed: Column, skipped: Column, seq_scan: Column, rows: Column, many: int = 1000) -> Column:
    """Null for failed or short-circuited plans; a sequential scan or many rows are POOR."""
    return F.when(failed | skipped, F.lit(None)).when(seq_scan | (rows >= many), "POOR").otherwise("EXCELLENT")


def worst_of(*ratings: Column | str) -> Column:
    """The worst rating; not applicable and null are neutral."""
    rank = [F.when(col(r) == "POOR", 1).when(col(r) == "GOOD", 2).when(col(r) == "EXCELLENT", 3) for r in ratings]
    worst = F.least(*rank)
    return F.when(worst == 1, "POOR").when(worst == 2, "GOOD").when(worst == 3, "EXCELLENT")


def size_bucket(rows: Column | str) -> Column:
    return F.when(col(rows) < 10_000, "SMALL").when(col(rows) < 1_000_000, "MEDIUM").otherwise("LARGE")


def skew_level(top_share: Column | str) -> Column:
    return F.when(col(top_share) > 0.5, "HIGH").when(col(top_share) > 0.2, "MEDIUM").otherwise("LOW")


# Widths of column types in an index key, by their prefixes in this order.
TYPE_WIDTHS = {
    "text": 1000, "json": 1000, "bytea": 1000, "xml": 1000, "uuid": 16, "bigint": 8, "numeric": 8, "decimal": 8, "double precision": 8, "timestamp": 8,
    "integer": 4, "int4": 4, "real": 4, "date": 4, "time": 4, "smallint": 2, "int2": 2, "boolean": 1,
}


def key_width(kind: Column | str) -> Column:
    """Declared length of a varchar or char, 1000 without one, else the type's fixed width, 8 if it is
    not known."""
    k = F.lower(F.trim(col(kind)))
    text = k.startswith("varchar") | k.startswith("char")
    out = F.when(text, F.coalesce(F.regexp_extract(k, r"\(\s*(\d+)", 1).try_cast("int"), F.lit(1000)))
    for name, width in TYPE_WIDTHS.items():
        out = out.when(k.startswith(name), width)
    return out.when(k == "bool", 1).otherwise(8)


# Literals by type prefix; the order of the prefixes counts.
LITERALS = {"int": "1", "bigint": "1", "smallint": "1", "numeric": "1", "decimal": "1", "double": "1.0", "bool": "true", "timestamp": "'2000-01-01 00:00:00'", "date": "'2000-01-01'", "time": "'00:00:00'", "json": "'{}'", "interval": "'1 day'"}


def safe_literal(kind: Column | str) -> Column:
    """A literal that a column of the type takes; interval starts with int, so it gives 1."""
    k = F.lower(F.trim(F.coalesce(col(kind), F.lit(""))))
    tests = [F.when(k.startswith(name), text) for name, text in LITERALS.items()]
    return F.coalesce(*tests, F.lit("'X'"))


def package_of(path: Column | str) -> Column:
    inner = F.regexp_extract(col(path), r"/(?:src/main/java|target/gen)/(.*)/[^/]*$", 1)
    return F.nullif(F.regexp_replace(inner, "/", "."), F.lit(""))


def renamed(path: Column | str) -> Column:
    """a/{b => c}/d and a => b give the new path."""
    braces = F.regexp_replace(col(path), r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(braces, r"^.* => ", ""), "//+", "/")


def module_of(path: Column | str) -> Column:
    """The last part that ends in -bcc."""
    return F.try_element_at(F.filter(F.split(col(path), "/"), lambda x: x.endswith("-bcc")), F.lit(-1))


def node_kind(name: Column | str) -> Column:
    n = F.lower(col(name))
    out = F.when(n.startswith("pbcb"), "pbcb")
    for kind in ("pbcp", "pbcc", "pbct", "pbs", "pcs"):
        out = out.when(n.startswith(kind), kind)
    return out.otherwise("service")


def is_component(prefix: Column | str) -> Column:
    return F.lower(col(prefix)).startswith("pbc")


def starts_with_any(text: Column | str, prefixes: list[str]) -> Column:
    t = F.upper(F.trim(col(text)))
    return reduce(lambda a, b: a | b, (t.startswith(p.upper()) for p in prefixes), F.lit(False))


def contains_any(keyword: str, *columns: Column | str) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(col(c)).contains(keyword.strip().lower()), F.lit(False)) for c in columns))


# Labels of approval states.
WHITELIST_LABELS = {"PENDING_L1": "待一级", "PENDING_L2": "待二级", "APPROVED": "已通过", "REJECTED_L1": "一级退回", "REJECTED_L2": "二级退回", "CANCELLED": "已取消"}


def _blank(x: Column) -> Column:
    return F.coalesce(~F.rlike(x, F.lit(r"\S")), F.lit(True))


def whitelist_label(status: Column | str) -> Column:
    """Label of an approval state; one that isn't known stays as it is."""
    s = col(status)
    known = F.create_map(*(F.lit(x) for pair in WHITELIST_LABELS.items() for x in pair))
    return F.when(_blank(s), "未申请").otherwise(F.coalesce(F.element_at(known, s), s))


def optimise_label(status: Column | str, optimised: Column | str, reappeared: Column | str) -> Column:
    """Label of an optimisation state with the rounds in which it was marked and came back."""
    # The labels.
    s, first, again = col(status), F.coalesce(col(optimised), F.lit("")), F.coalesce(col(reappeared), F.lit(""))
    return F.when(_blank(s), "未处理").when(s == "OPTIMIZED", F.concat(F.lit("已优化@"), first)).when(s == "REGRESSED", F.concat(F.lit("优化未生效("), first, F.lit("标→"), again, F.lit("现)"))).otherwise(s)


def optimise_operator(name: Column | str, number: Column | str) -> Column:
    """name(number), or the one that there is."""
    a, b = F.coalesce(col(name), F.lit("")), F.coalesce(col(number), F.lit(""))
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit("("), b, F.lit(")")))


def build_status(stage: Column | str, status: Column | str) -> Column:
    """(text, type) of a build: the stage of the asynchronous build before its status."""
    # The stages, states and texts.
    n = F.regexp_replace(F.coalesce(col(stage), F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    s = F.upper(col(status))
    good = F.struct(F.lit("成功").alias("text"), F.lit("success").alias("type"))
    bad = F.struct(F.lit("失败").alias("text"), F.lit("error").alias("type"))
    return F.when(n == "成功", good).when(n.contains("失败"), bad).when(s == "SUCCESS", good).when(s == "FAILED", bad).otherwise(F.struct(F.lit("构建中").alias("text"), F.lit("running").alias("type")))


def chain_findings(services: Column | str, components: Column | str, tables: Column | str, snippets: Column | str) -> Column:
    """Findings (key, severity, evidence) of a chain's counts; no count is 0."""
    # Keys, severities and limits.
    rules = [(services, "deep-service-chain", "medium", "serviceCount", 8), (components, "wide-component-fanout", "medium", "componentCount", 10), (tables, "multi-table-access", "medium", "tableCount", 8), (snippets, "missing-snippets", "info", "codeSnippets", None)]
    found = []
    for column, key, severity, name, least in rules:
        n = F.coalesce(col(column).cast("long"), F.lit(0))
        hit = n >= least if least else n == 0
        found.append(F.when(hit, F.struct(F.lit(key).alias("key"), F.lit(severity).alias("severity"), F.concat(F.lit(f"{name}="), n.cast("string")).alias("evidence"))))
    return F.array_compact(F.array(*found))


def _listed(json: Column | str, fields: list[str], shown, between: str) -> Column:
    """A JSON list of objects as text, blank where it is; what cannot be read stays as it is."""
    text = col(json)
    found = F.from_json(text, f"array<struct<{','.join(f'{f}:string' for f in fields)}>>")
    lines = F.array_join(F.transform(found, shown), between)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "").when(found.isNull(), text).otherwise(lines)


def findings_text(json: Column | str) -> Column:
    """[SEVERITY] type - description, a line a finding; LOW is the severity of those without."""
    part = lambda x, f, other="": F.coalesce(x[f], F.lit(other))
    tail = lambda x: F.when(part(x, "description") != "", F.concat(F.lit(" - "), x["description"])).otherwise("")
    return _listed(json, ["severity", "type", "description"], lambda x: F.concat(F.lit("["), part(x, "severity", "LOW"), F.lit("] "), part(x, "type"), tail(x)), "\n")


def suggestions_text(json: Column | str) -> Column:
    """Suggestions with their scope, reason, DDL and new SQL, a blank line between."""
    # The labels of the parts.
    part = lambda x, f: F.coalesce(x[f], F.lit(""))
    line = lambda x, f, label, end: F.when(part(x, f) != "", F.concat(F.lit(label), x[f], F.lit(end))).otherwise("")
    scope = lambda x: F.when(F.upper(F.coalesce(x["scope"], F.lit("SQL"))) == "TABLE", "【表级】").otherwise("【SQL 级】")
    whole = lambda x: F.concat(scope(x), part(x, "type"), F.lit("\n"), line(x, "reason", "理由：", "\n"), line(x, "ddl", "DDL：", "\n"), line(x, "newSql", "新 SQL：", ""))
    return F.regexp_replace(_listed(json, ["scope", "type", "reason", "ddl", "newSql"], whole, "\n\n"), r"^\s+|\s+$", "")
