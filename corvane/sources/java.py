"""Facts of Java sources. A small scanner in the tasks reads each file once and tells what stands
where: types, methods, fields, imports, calls, throws and variables that hold a service. All that
takes more than one file or scope is done by joins: which method a call is in, which type is the
innermost around a throw, what a simple name means, which of the seven forms a call has.

Types of a package are named `package.Simple`, also nested ones; a simple name that several files
declare means the one of the first path. A file is bounded (max_bytes), so joins inside a file are
bounded too."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import partitions
from ..operators.windows import best, top_per

MAX_BYTES = 2 << 20
#: Facts that leave a task at once, or those of one file more.
BATCH = 8192

FACT = "path string, fact string, pos int, stop int, line int, kind string, name string, detail string, items array<string>"
FIELDS = [x.split()[0] for x in FACT.split(", ")]

TOKEN = re.compile(r'//[^\n]*+|/\*.*?(?:\*/|\Z)|"""(?:\\.|[^\\])*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*+"?|\'(?:\\.|[^\'\\\n])*+\'?|[^\W\d][\w$]*+|\$[\w$]*+|\d[\w.]*+|->|::|[^\s]', re.S)
NAME = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
# Java's words that stand before a parenthesis without being a call, and its modifiers.
NOT_CALLED = frozenset("assert catch do else for if new return super switch synchronized this throw try while yield case".split())
MODIFIERS = frozenset("abstract default final native non private protected public sealed static strictfp synchronized transient volatile".split())
KINDS = frozenset("class interface enum record".split())
IN_ANGLES = frozenset("< > . , ? & [ ] @".split())
# Names of the service look-up, and methods of Object that are no calls inside a class.
LOOKUPS = frozenset("getInstance getRemoteInstance getInsance".split())
OF_OBJECT = ["toString", "hashCode", "equals", "getClass", "notify", "notifyAll", "wait"]
CODE = re.compile(r"[A-Z]\d{3,4}")
STATEMENT = re.compile(r"@Statement\s*\(")


class Source:
    """The tokens of a file without comments, partners of brackets, and the facts found."""

    def __init__(self, text: str):
        self.text = text
        found = [(m[0], m.start()) for m in TOKEN.finditer(text) if not m[0].startswith(("//", "/*"))]
        self.word, self.at = [w for w, _ in found], [a for _, a in found]
        self.partner: dict[int, int] = {}
        open_: list[int] = []
        for k, w in enumerate(self.word):
            if w in "([{" and len(w) == 1:
                open_.append(k)
            elif w in ")]}" and len(w) == 1:
                wanted = "([{"[")]}".index(w)]
                while open_ and self.word[open_[-1]] != wanted:
                    open_.pop()
                if open_:
                    self.partner[k] = open_[-1]
                    self.partner[open_.pop()] = k
        self.facts: list[tuple] = []
        self.line_at, self.lines = 0, 1

    def line(self, k: int) -> int:
        """The line of token k; tokens are asked for nearly in order."""
        at = self.at[k]
        if at < self.line_at:
            return self.text.count("\n", 0, at) + 1
        self.lines += self.text.count("\n", self.line_at, at)
        self.line_at = at
        return self.lines

    def tell(self, fact: str, k: int, stop: int, kind: str | None, name: str | None, detail: str | None = None, items: list[str] | None = None) -> None:
        self.facts.append((fact, self.at[k], stop, self.line(k), kind, name, detail, items))

    def after_angles(self, k: int) -> int:
        """The token after the type arguments that open at k; the next one if it only compares."""
        depth, j = 0, k
        while j < len(self.word) and (self.word[j] in IN_ANGLES or NAME.fullmatch(self.word[j])):
            depth += (self.word[j] == "<") - (self.word[j] == ">")
            j += 1
            if not depth:
                return j
        return k + 1

    def before_angles(self, k: int) -> int:
        """The token before the type arguments that close at k; -1 if it only compares."""
        depth, j = 0, k
        while j >= 0 and (self.word[j] in IN_ANGLES or NAME.fullmatch(self.word[j])):
            depth += (self.word[j] == ">") - (self.word[j] == "<")
            j -= 1
            if not depth:
                return j
        return -1

    def bare(self, first: int, last: int) -> list[int]:
        """Tokens first to last without annotations and modifiers."""
        out, k = [], first
        while k < last:
            if self.word[k] == "@" and k + 1 < last and self.word[k + 1] != "interface":
                k += 2
                while k + 1 < last and self.word[k] == ".":
                    k += 2
                if k < last and self.word[k] == "(":
                    k = self.partner.get(k, last) + 1
                continue
            if not (self.word[k] in MODIFIERS or self.word[k] == "-" and self.word[k - 1] == "non"):
                out.append(k)
            k += 1
        return out

    def types(self, tokens: list[int]) -> list[str]:
        """Type names of a list parted by commas, without type arguments."""
        out, depth, now = [], 0, ""
        for k in tokens:
            w = self.word[k]
            depth += (w == "<") - (w == ">")
            if w == "," and not depth:
                out.append(now)
                now = ""
            elif not depth and w != ">":
                now += w
        return [x for x in [*out, now] if x]

    def parameters(self, open_: int) -> list[str]:
        """Types of the parameters in the parentheses from open_."""
        out, depth, now = [], 0, []
        for k in [*self.bare(open_ + 1, self.partner.get(open_, open_)), -1]:
            w = self.word[k] if k >= 0 else ","
            if w == "," and not depth:
                if now:
                    names = [x for x in now if NAME.fullmatch(x)]
                    cut = len(now) - 1 - now[::-1].index(names[-1])  # the name, and brackets after it
                    if names[-1] != "this":
                        out.append("".join(x for x in now[:cut] if x != ".") if "..." in "".join(now[:cut]) else "".join(now[:cut] + now[cut + 1 :]))
                now = []
                continue
            if w == "<":
                depth += 1
            elif w == ">":
                depth -= 1
            elif not depth:
                now.append(w)
        return out

    def chain(self, k: int) -> int:
        """The first token of the primary expression that ends at k, which stands before a dot."""
        while k >= 0:
            w = self.word[k]
            if w in (")", "]"):
                k = self.partner.get(k, 0) - 1
                if k >= 0 and self.word[k] == ">":
                    k = self.before_angles(k)
                if k < 0 or not (NAME.fullmatch(self.word[k]) and self.word[k] not in NOT_CALLED or self.word[k] in ("this", "super", "]", ")")):
                    return k + 1
                continue
            if k and self.word[k - 1] == "new":
                k -= 1
            if k >= 2 and self.word[k - 1] == ".":
                k -= 2
                continue
            if k >= 2 and self.word[k - 1] == ">" and (j := self.before_angles(k - 1)) > 0 and self.word[j] == ".":
                k = j - 1
                continue
            if k >= 1 and self.word[k - 1] == "new":
                k -= 1
            return k
        return 0

    def lookup(self, first: int, close: int) -> tuple[bool, str | None]:
        """Whether tokens first to close are SysUtil.getInstance(...), and X of an argument X.class."""
        open_ = self.partner.get(close, -1)
        if self.word[close] != ")" or open_ != first + 3 or self.word[first : first + 2] != ["SysUtil", "."] or self.word[first + 2] not in LOOKUPS:
            return False, None
        inner = self.word[open_ + 1 : close]
        end = inner.index(",") if "," in inner else len(inner)
        return True, "".join(inner[: end - 2]) if end > 2 and inner[end - 2 : end] == [".", "class"] else None


def scanned(text: str) -> list[tuple]:
    """(fact, pos, stop, line, kind, name, detail, items) of a source."""
    s = Source(text)
    word, n = s.word, len(s.word)
    package = ""
    # what is open: a type's body (anon: without a name), a block or a field's first value (init); where it ends
    bodies: list[tuple[str, int]] = []
    constants: set[int] = set()  # ends of enum bodies whose constants are not all read
    kept: dict[int, str] = {}  # by the end of a first value: the type of its field
    start = k = 0
    while k < n:
        w = word[k]
        if bodies and bodies[-1] == ("init", k):
            bodies.pop()
            k, start = _next_field(s, k, kept.pop(k), kept, bodies)
            continue
        inside = bodies[-1][0] if bodies else "type"
        if not bodies and w in ("package", "import"):
            stop = next((j for j in range(k, n) if word[j] == ";"), n)
            name = "".join(x for x in word[k + 1 : stop] if x != "static") if word[k + 1 : k + 2] == ["static"] else "".join(word[k + 1 : stop])
            if w == "package":
                package = name
            elif not name.endswith("*"):
                s.tell("import", k, s.at[k], None, name.rpartition(".")[2], name)
            start = k = stop + 1
            continue
        if w == "}":
            if bodies:
                bodies.pop()
            k += 1
            start = k
            continue
        kind = w if w in KINDS and k + 1 < n and NAME.fullmatch(word[k + 1]) and (not k or word[k - 1] not in (".", "::")) else None
        if kind == "record" and not (k + 2 < n and word[k + 2] in ("(", "<")):
            kind = None
        if kind and (inside in ("type", "anon") or kind != "record" or word[k - 1] in ("{", "}", ";", "final", "static")):
            header = k + 2
            parts: dict[str, list[int]] = {"": []}
            now, j = "", header
            while j < n and word[j] not in ("{", ";"):
                if word[j] == "<" and not now:
                    j = s.after_angles(j)
                    continue
                if word[j] == "(":
                    j = s.partner.get(j, j) + 1
                    continue
                if word[j] in ("extends", "implements", "permits") and (word[j - 1] != "?"):
                    now = word[j]
                    parts[now] = []
                else:
                    parts[now].append(j)
                j += 1
            if j < n and word[j] == "{":
                stop = s.partner.get(j, n - 1)
                told = "annotation" if k and word[k - 1] == "@" else kind
                s.tell("type", k, s.at[stop], told, word[k + 1], package)
                for relation in ("extends", "implements"):
                    if parts.get(relation):
                        s.tell(relation, k, s.at[stop], told, word[k + 1], package, s.types(s.bare(parts[relation][0], parts[relation][-1] + 1)))
                bodies.append(("type", stop))
                if kind == "enum":
                    constants.add(stop)
                start = k = j + 1
                continue
        if inside in ("type", "anon"):
            if w == "@" and k + 1 < n and word[k + 1] != "interface":
                k += 2
                while k + 1 < n and word[k] == ".":
                    k += 2
                if k < n and word[k] == "(":
                    k = s.partner.get(k, n) + 1
                continue
            if bodies and bodies[-1][1] in constants:
                if w == ";":
                    constants.discard(bodies[-1][1])
                elif w == "{":
                    bodies.append(("anon", s.partner.get(k, n - 1)))
                elif w == "(":
                    k = s.partner.get(k, n)
                k += 1
                start = k
                continue
            if w == "<":
                k = s.after_angles(k)
                continue
            if w == "(" and bodies:
                head = s.bare(start, k)
                if head and word[head[0]] == "<":  # type parameters
                    after = s.after_angles(head[0])
                    head = [x for x in head if x >= after]
                close = s.partner.get(k, n - 1)
                j = close + 1
                while j < n and word[j] not in ("{", ";", "}"):
                    j = s.partner.get(j, j) + 1 if word[j] == "(" else j + 1
                stop = s.partner.get(j, n - 1) if j < n and word[j] == "{" else min(j, n - 1)
                if len(head) > 1 and NAME.fullmatch(word[head[-1]]):
                    s.tell("method", start, s.at[stop], "named" if inside == "type" else "anonymous", word[head[-1]], package, s.parameters(k))
                if j < n and word[j] == "{":
                    bodies.append(("block", stop))
                start = k = j + 1
                continue
            if w in ("=", ";", ",") and bodies:
                head = s.bare(start, k)
                names = [x for x in head if NAME.fullmatch(word[x])]
                if len(head) > 1 and names:
                    kind = (s.types(head[: head.index(names[-1])]) or [""])[-1].replace("[]", "") if inside == "type" else ""
                    k, start = _next_field(s, k, kind, kept, bodies, names[-1])
                    continue
                k += 1
                start = k
                continue
            if w == "{":
                bodies.append(("block", s.partner.get(k, n - 1)))
                k += 1
                start = k
                continue
            k += 1
            continue
        # inside a block
        if w == "{":
            anonymous = k and word[k - 1] == ")" and _created(s, s.partner.get(k - 1, 0))
            bodies.append(("anon" if anonymous else "block", s.partner.get(k, n - 1)))
            k += 1
            start = k
            continue
        if w == "throw":
            stop = k + 1
            while stop < n and word[stop] not in (";", "}"):
                stop = s.partner.get(stop, stop) + 1
            last = min(stop, n) - 1
            open_ = s.partner.get(last, -1)
            if word[last] == ")" and open_ - 2 > k and CODE.fullmatch(word[open_ - 1]) and word[open_ - 2] == "." and s.chain(open_ - 3) == k + 1:
                pieces = [text[s.at[j] : s.at[j] + len(word[j])] for j in range(k, last + 1)]
                gaps = [" " if s.at[j + 1] > s.at[j] + len(word[j]) and word[j + 1] not in (")", "]", ",", ".") else "" for j in range(k, last)]
                shown = "".join(p + g for p, g in zip(pieces, [*gaps, ""])) + ";"
                s.tell("throw", k, s.at[last], "".join(word[k + 1 : open_ - 2]), word[open_ - 1], shown)
        if w == "=" and k + 3 < n and word[k + 1] == "SysUtil" and NAME.fullmatch(word[k - 1]) and (k < 2 or word[k - 2] != "."):
            close = s.partner.get(k + 4, -1)
            if close > 0 and close + 1 < n and word[close + 1] in (";", ",", ")"):
                found, argument = s.lookup(k + 1, close)
                if found and argument:
                    s.tell("holds", k, s.at[close], None, word[k - 1], argument)
        if w == "(" and k and NAME.fullmatch(word[k - 1]) and word[k - 1] not in NOT_CALLED:
            first = k - 1
            dotted = k - 2
            if dotted > 0 and word[dotted] == ">" and (j := s.before_angles(dotted)) >= 0 and word[j] == ".":
                dotted = j  # type arguments of the call
            if dotted > 0 and word[dotted] == ".":
                first = s.chain(dotted - 1)
                scope = word[first:dotted]
                found, argument = s.lookup(first, dotted - 1)
                if word[first] == "new" and s.partner.get(k - 1) is None and all(x == "." or NAME.fullmatch(x) for x in scope):
                    form = None  # new a.B(
                elif found:
                    form = "lookup"
                elif len(scope) == 1 and NAME.fullmatch(scope[0]) and scope[0] not in ("this", "super"):
                    form = "name"
                elif len(scope) > 2 and scope[-2] == "." and NAME.fullmatch(scope[-1]) and scope[-1] != "this":
                    form = "field"
                else:
                    form = "other"
                if form and (not first or word[first - 1] != "@"):
                    last = argument if form == "lookup" else scope[-1]
                    s.tell("call", first, s.at[k], form, word[k - 1], last)
            elif word[k - 2] not in ("new", "@", "::") if k > 1 else True:
                s.tell("call", first, s.at[k], "none", word[k - 1])
        k += 1
    return s.facts


def _next_field(s: Source, k: int, kind: str, kept: dict[int, str], bodies: list[tuple[str, int]], name: int | None = None) -> tuple[int, int]:
    """Tells a field of this type, and those after commas; (where to go on, where the next member
    begins). A first value is left open, to be read as a block."""
    n = len(s.word)
    if name is not None and kind:
        s.tell("field", name, s.at[k], None, s.word[name], kind)
    while k < n and s.word[k] == "," and k + 1 < n:
        k += 1
        if kind and NAME.fullmatch(s.word[k]):
            s.tell("field", k, s.at[k], None, s.word[k], kind)
        while k + 1 < n and s.word[k + 1] in ("[", "]"):
            k += 1
        k += 1
    if k < n and s.word[k] == "=":
        end = k + 1
        while end < n and s.word[end] not in (";", ",", "}"):
            j = s.after_angles(end) if s.word[end] == "<" else end
            end = j if j > end + 1 else s.partner.get(end, end) + 1 if s.word[end] in ("(", "[", "{") else end + 1
        bodies.append(("init", end))
        kept[end] = kind
    return k + 1, k + 1


def _created(s: Source, open_: int) -> bool:
    """Whether the parentheses from open_ belong to a new object."""
    k = open_ - 1
    while k >= 0:
        if s.word[k] == ">":
            k = s.before_angles(k)
        elif s.word[k - 1] == "new" and k:
            return True
        elif k and s.word[k - 1] == ".":
            k -= 2
        else:
            return False
    return False


def sqls(text: str) -> list[str]:
    """SQL texts of the file's @Statement annotations: the attribute sql in any place, literals joined
    by plus, in parentheses or not."""
    out, k = [], 0
    while m := STATEMENT.search(text, k):
        k, depth, after, value = m.end(), 1, "", None
        pieces: list[str] | None = None
        for token in TOKEN.finditer(text, m.end()):
            w = token[0]
            if w.startswith(("//", "/*")):
                continue
            if pieces is not None and value is None:
                if w[0] == '"':
                    pieces.append(unescaped(w))
                elif w not in ("+", "("):
                    value = "".join(pieces) if pieces else ""
            if w == "=" and after == "sql" and depth == 1 and pieces is None:
                pieces = []
            depth += (w == "(") - (w == ")")
            if not depth:
                k = token.end()
                value = "".join(pieces or []) if value is None else value
                if value.strip():
                    out.append(value.strip())
                break
            after = w
    return out


ESCAPE = re.compile(r"\\(.)", re.S)
#: Escapes that are read; others stay as they stand.
ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'"}


def unescaped(literal: str) -> str:
    quotes = 3 if literal.startswith('"""') else 1
    inner = literal[quotes : -quotes if len(literal) > quotes and literal.endswith('"') else None]
    return ESCAPE.sub(lambda m: ESCAPED.get(m[1], m[0]), inner)


def facts(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files(path, content) -> a row a fact; those of files over max_bytes are none but `oversized`,
    null contents have none. Reading a file takes far longer than moving it, so files are dealt to
    tasks by their paths, however few the tasks that bring them; facts leave a task in batches of
    many files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], FIELDS)

        rows: list[tuple] = []
        for batch in batches:
            for path, content in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                if content is None:
                    continue
                if len(content.encode()) > max_bytes:
                    found = [("oversized", 0, 0, 0, None, None, None, None)]
                else:
                    statements = sqls(content) if "@Statement" in content else []
                    found = scanned(content) + [("sql", k, 0, 0, None, None, x, None) for k, x in enumerate(statements)]
                rows.extend((path, *x) for x in found)
                if len(rows) >= BATCH:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    files = files.select("path", "content")
    return files.repartition(partitions(files), "path").mapInArrow(run, FACT)


def _fqn(package: str, name: str) -> Column:
    return F.when(F.col(package) == "", F.col(name)).otherwise(F.concat_ws(".", package, name))


def types(found: DataFrame) -> DataFrame:
    """(path, pos, stop, line, kind, name, package, fqn) of every declared type, nested and local ones too."""
    return found.where("fact = 'type'").select("path", "pos", "stop", "line", "kind", "name", F.col("detail").alias("package"), _fqn("detail", "name").alias("fqn"))


def first_seen(found: DataFrame) -> DataFrame:
    """(name, fqn): what a simple name means beyond a file, the class or interface of the first path."""
    declared = types(found).where("kind IN ('class', 'interface')")
    return declared.groupBy("name").agg(F.min_by("fqn", F.struct("path", "pos")).alias("fqn"))


def methods(found: DataFrame) -> DataFrame:
    """(path, pos, stop, line, name, owner_kind, class_fqn, signature): methods by the innermost named
    type around them; those of anonymous classes have no owner."""
    m = found.where("fact = 'method'").select("path", "pos", "stop", "line", "name", "kind", "items")
    t = types(found).select("path", F.col("pos").alias("t_pos"), F.col("stop").alias("t_stop"), F.col("kind").alias("owner_kind"), "fqn")
    keys = ["path", "pos", "stop", "line", "name", "items", "kind"]
    around = m.alias("m").join(t.alias("t"), F.expr("m.path = t.path AND t_pos < m.pos AND m.stop <= t_stop"))
    inner = around.groupBy(*(F.col(f"m.{k}") for k in keys)).agg(F.max_by(F.struct("owner_kind", "fqn"), "t_pos").alias("t"))
    named = F.col("kind") == "named"
    signature = F.concat(F.col("t.fqn"), F.lit("#"), F.col("name"), F.lit("("), F.array_join("items", ","), F.lit(")"))
    return inner.select("path", "pos", "stop", "line", "name", F.when(named, F.col("t.owner_kind")).alias("owner_kind"), F.when(named, F.col("t.fqn")).alias("class_fqn"), F.when(named, signature).alias("signature"))


def _meant(rows: DataFrame, name: str, found: DataFrame) -> DataFrame:
    """rows(path, package, name) with `target`: a dotted name as it stands, else the file's import, the
    first type of that name anywhere, or a type of the own package."""
    imports = found.where("fact = 'import'").groupBy("path", F.col("name").alias(name)).agg(F.max_by("detail", "pos").alias("imported"))
    seen = first_seen(found).select(F.col("name").alias(name), F.col("fqn").alias("seen"))
    joined = rows.join(imports, ["path", name], "left").join(seen, name, "left")
    own = F.when(F.col("package") == "", F.col(name)).otherwise(F.concat_ws(".", "package", name))
    return joined.withColumn("target", F.when(F.col(name).contains("."), F.col(name)).otherwise(F.coalesce("imported", "seen", own))).drop("imported", "seen")


def type_edges(found: DataFrame) -> DataFrame:
    """(etype, src, dst): EXTENDS and IMPLEMENTS of classes; repeated ones stay single."""
    rows = found.where("fact IN ('extends', 'implements') AND kind = 'class'")
    rows = rows.select("path", F.upper("fact").alias("etype"), _fqn("detail", "name").alias("src"), F.col("detail").alias("package"), F.explode("items").alias("parent"))
    return _meant(rows, "parent", found).select("etype", "src", F.col("target").alias("dst")).distinct()


def calls(found: DataFrame, targets: DataFrame | None = None, packages: list[str] | None = None) -> DataFrame:
    """(caller, etype, target, method_name, line_no), a row a call of each class's method around it, by
    the seven forms in this order: no scope (SELF_CALLS, without Object's methods); a look-up and a
    variable that holds one (SYS_UTIL_CALLS); a scope or a field's type named ...Dao (DAO_CALLS to
    `Dao#method`); a field and a type's name (CALLS); `a.BDao` (DAO_CALLS). Other scopes make no edge.
    targets(type_id, package_path): the services that a look-up may name, all if None. packages: the
    prefixes of callers, and of the targets of CALLS, that count; all named ones if None."""
    included = (lambda c: F.lit(False) if not packages else F.exists(F.array(*map(F.lit, packages)), lambda p: F.startswith(c, p))) if packages is not None else lambda c: F.coalesce(c, F.lit("")) != ""
    m = methods(found).where((F.col("owner_kind") == "class") & included(F.col("class_fqn")))
    m = m.select("path", F.col("pos").alias("m_pos"), F.col("stop").alias("m_stop"), F.col("signature").alias("caller"), "class_fqn")
    m = m.withColumn("package", F.regexp_extract("class_fqn", r"^(?:(.*)\.)?[^.]*$", 1))
    here = "f.path = m.path AND f.pos > m.m_pos AND f.pos < m.m_stop"
    c = found.where("fact = 'call'").alias("f").join(m.alias("m"), F.expr(here)).select("f.path", "m_pos", "caller", "class_fqn", "package", "f.pos", F.col("f.line").alias("line_no"), F.col("f.kind").alias("form"), F.col("f.name").alias("method_name"), F.col("f.detail").alias("scope"))
    holds = found.where("fact = 'holds'").alias("f").join(m.alias("m"), F.expr(here))
    holds = holds.select("f.path", "m_pos", "package", F.col("f.name").alias("scope"), "f.pos", F.regexp_replace("f.detail", r"<.*>|\[\]", "").alias("service"))
    if targets is not None:
        known = targets.select(F.col("type_id").alias("service"), "package_path").groupBy("service").agg(F.max("package_path").alias("package_path"))
    else:
        known = None

    def served(rows: DataFrame) -> DataFrame:
        """rows(path, package, service) of known services, with where they lead."""
        rows = rows.join(known, "service") if known is not None else rows.withColumn("package_path", F.lit(None).cast("string"))
        path = F.translate(F.trim("package_path"), "/", ".")
        own = F.when(path.endswith(F.concat(F.lit("."), F.col("service"))) | (path == F.col("service")), path).otherwise(F.concat_ws(".", path, "service"))
        rows = _meant(rows, "service", found)
        # an import and the index come before the path of the registry, that before the own package
        guessed = F.col("target") == F.when(F.col("package") == "", F.col("service")).otherwise(F.concat_ws(".", "package", "service"))
        return rows.withColumn("target", F.when(guessed & (F.coalesce(path, F.lit("")) != "") & ~F.col("service").contains("."), own).otherwise(F.col("target")))

    edge = lambda rows, etype, target: rows.select("caller", F.lit(etype).alias("etype"), target.alias("target"), "method_name", "line_no")
    out = edge(c.where((F.col("form") == "none") & ~F.col("method_name").isin(OF_OBJECT)), "SELF_CALLS", F.col("class_fqn"))
    chain = served(c.where("form = 'lookup' AND scope IS NOT NULL").withColumn("service", F.regexp_replace("scope", r"<.*>|\[\]", "")))
    out = out.unionByName(edge(chain, "SYS_UTIL_CALLS", F.col("target")))
    variable = served(holds).groupBy("path", "m_pos", "scope").agg(F.max_by("target", "pos").alias("held"))
    named = c.where("form = 'name'").join(variable, ["path", "m_pos", "scope"], "left")
    out = out.unionByName(edge(named.where("held IS NOT NULL"), "SYS_UTIL_CALLS", F.col("held")))
    fields = owned_fields(found).select("path", "class_fqn", F.col("name").alias("scope"), F.col("type").alias("field_type"))
    rest = named.where("held IS NULL").drop("held").join(fields, ["path", "class_fqn", "scope"], "left")
    dao = F.when(F.col("scope").rlike(r"^\w+Dao$"), F.col("scope")).when(F.element_at(F.split("field_type", r"\."), -1).rlike(r"^\w+Dao$"), F.element_at(F.split("field_type", r"\."), -1))
    rest = rest.withColumn("dao", dao)
    static = c.where(F.col("form") == "field").withColumn("dao", F.when(F.col("scope").rlike(r"^\w+Dao$"), F.col("scope")))
    daos = rest.select("caller", "dao", "method_name", "line_no").unionByName(static.select("caller", "dao", "method_name", "line_no")).where("dao IS NOT NULL")
    out = out.unionByName(edge(daos, "DAO_CALLS", F.concat_ws("#", "dao", "method_name")))
    plain = rest.where("dao IS NULL AND (field_type IS NOT NULL OR scope <> 'SysUtil')").withColumn("type", F.coalesce("field_type", "scope"))
    plain = _meant(plain, "type", found)
    return out.unionByName(edge(plain.where(included(F.col("target"))), "CALLS", F.col("target")))


def owned_fields(found: DataFrame) -> DataFrame:
    """(path, class_fqn, name, type): fields of the innermost type around them; a later one of the same
    name counts."""
    f = found.where("fact = 'field'").select("path", "pos", F.col("name"), F.col("detail").alias("type"))
    t = types(found).select("path", F.col("pos").alias("t_pos"), F.col("stop").alias("t_stop"), "fqn")
    inner = f.alias("f").join(t.alias("t"), F.expr("f.path = t.path AND t_pos < f.pos AND f.pos < t_stop")).groupBy("f.path", "f.pos", "f.name", "f.type").agg(F.max_by("fqn", "t_pos").alias("class_fqn"))
    return best(inner, ["path", "class_fqn", "name"], [F.desc("pos")]).select("path", "class_fqn", "name", "type")


def thrown(found: DataFrame) -> DataFrame:
    """(path, pos, line_no, code, scope, throw_text, class_fqn, method_name): each `throw Scope.X1234(...)`
    with the innermost named type and method around it, `<unknown>` where there is none."""
    x = found.where("fact = 'throw'").select("path", "pos", F.col("line").alias("line_no"), F.col("name").alias("code"), F.col("kind").alias("scope"), F.col("detail").alias("throw_text"))
    t = types(found).select("path", F.col("pos").alias("t_pos"), F.col("stop").alias("t_stop"), "fqn")
    m = found.where("fact = 'method'").select("path", F.col("pos").alias("m_pos"), F.col("stop").alias("m_stop"), F.col("name").alias("method_name"))
    keys = ["path", "pos", "line_no", "code", "scope", "throw_text"]
    typed = x.alias("x").join(t.alias("t"), F.expr("x.path = t.path AND t_pos < x.pos AND x.pos < t_stop"), "left").groupBy(*(F.col(f"x.{k}") for k in keys)).agg(F.max_by("fqn", "t_pos").alias("class_fqn"))
    whole = typed.alias("x").join(m.alias("m"), F.expr("x.path = m.path AND m_pos < x.pos AND x.pos < m_stop"), "left").groupBy(*(F.col(f"x.{k}") for k in [*keys, "class_fqn"])).agg(F.max_by("method_name", "m_pos").alias("method_name"))
    return whole.select(*keys, F.coalesce("class_fqn", F.lit("<unknown>")).alias("class_fqn"), F.coalesce("method_name", F.lit("<unknown>")).alias("method_name"))


def statements(found: DataFrame) -> DataFrame:
    """(path, at, class_fqn, sql, oversized): the SQL of @Statement annotations in order, and a row
    without SQL for each file that was too large to read. The class is the file's first type, else its name."""
    first = types(found).groupBy("path").agg(F.min_by("fqn", "pos").alias("class_fqn"))
    rows = found.where("fact IN ('sql', 'oversized')").select("path", F.col("pos").alias("at"), F.col("detail").alias("sql"), (F.col("fact") == "oversized").alias("oversized"))
    return rows.join(first, "path", "left").select("path", "at", F.coalesce("class_fqn", F.element_at(F.split("path", "/"), -1)).alias("class_fqn"), "sql", "oversized")


# Fixed value: what stands under a snippet that was cut.
CUT = "\n// ... snippet truncated ..."


def snippets(chain: DataFrame, found: DataFrame, files: DataFrame, limit: int, most: int) -> DataFrame:
    """(tx, rank, node, path, method_name, start_line, end_line, content): of each chain(tx, ord, node,
    path, method_name) the first `limit` nodes whose file has a method of that name, with the first such
    method's text, cut after `most` characters under a mark. Ranks are dealt before contents are read,
    and a file's text meets only the methods that are shown."""
    named = found.where("fact = 'method'").groupBy("path", F.col("name").alias("method_name")).agg(F.min(F.struct("pos", "stop", "line")).alias("m"))
    shown = top_per(chain.select("tx", "ord", "node", "path", "method_name").join(named, ["path", "method_name"]), ["tx"], limit, F.asc("ord"), F.asc("node"))
    body = F.col("content").substr(F.col("m.pos") + 1, F.col("m.stop") - F.col("m.pos") + 1)
    texts = shown.select("path", "method_name", "m").distinct().join(files.select("path", "content"), "path").select("path", "method_name", body.alias("body"))
    whole = shown.join(texts, ["path", "method_name"])
    lines = F.col("m.line") + F.length("body") - F.length(F.translate("body", "\n", ""))
    cut = F.when(F.char_length("body") > most, F.concat(F.left("body", F.lit(most)), F.lit(CUT))).otherwise(F.col("body"))
    return whole.select("tx", "rank", "node", "path", "method_name", F.col("m.line").alias("start_line"), lines.alias("end_line"), cut.alias("content"))
