"""Inventories of source files: declarations, imports, members, signals and import edges.

A file is read once, by one scanner for its language; everything else is a
DataFrame over the rows that the scanners emit.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = {".py": "python", ".rs": "rust", ".dart": "dart", ".ts": "typescript", ".tsx": "typescript"}
PRUNED = ("node_modules", "target", ".dart_tool", ".git")
HOOKS = ("useState", "useRef", "useMemo", "useCallback", "useSyncExternalStore")
#: section: file, import, decl, member, signal, edge. owner: the declaration that a member or signal belongs to.
SCHEMA = "file string, language string, section string, seq long, kind string, name string, start long, end long, exported string, owner string, text string"


@dataclass
class Row:
    """One finding of a scanner."""

    section: str
    kind: str = ""
    name: str = ""
    start: int = 0
    end: int = 0
    exported: str = ""
    owner: str = ""
    text: str = ""


def _collapsed(text: str) -> str:
    return " ".join(text.split())


# --- Python -----------------------------------------------------------------------------


def scan_python(text: str, path: str = "") -> list[Row]:
    """Top-level statements of a module; a module that doesn't parse gives an "error" signal alone."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return [Row("signal", "error", text=str(e).split("\n")[0])]
    rows: list[Row] = []
    listed = next((s.value for s in tree.body if isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in s.targets)), None)
    public = {e.value for e in listed.elts if isinstance(e, ast.Constant)} if isinstance(listed, (ast.List, ast.Tuple)) else None
    shown = lambda n: "yes" if (n in public if public is not None else not n.startswith("_")) else "no"

    def add(kind: str, name: str, s: ast.stmt, exported: str | None = None) -> None:
        rows.append(Row("decl", kind, name, s.lineno, s.end_lineno or s.lineno, exported or shown(name)))

    for s in tree.body:
        if isinstance(s, (ast.Import, ast.ImportFrom)):
            rows.append(Row("import", text=_collapsed(ast.unparse(s)), start=s.lineno, end=s.end_lineno or s.lineno))
        elif isinstance(s, ast.ClassDef):
            add("class", s.name, s)
            rows += [Row("member", "method", f.name, f.lineno, f.end_lineno or f.lineno, owner=s.name) for f in s.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))]
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add("function", s.name, s)
        elif isinstance(s, ast.TypeAlias):
            add("type", s.name.id, s, "yes")
        elif isinstance(s, (ast.Assign, ast.AnnAssign)):
            for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                if isinstance(t, ast.Name):
                    add("const", t.id, s)
        for d in getattr(s, "decorator_list", []):
            rows.append(Row("signal", "decorator", start=d.lineno, owner=s.name, text="@" + ast.unparse(d)))
    own = path.removesuffix(".py").split("/")
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            f = n.func
            called = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
            if called in ("getattr", "globals", "vars", "__import__", "import_module"):
                rows.append(Row("signal", "dynamic", called, n.lineno, text=ast.unparse(n)))
        elif isinstance(n, ast.Import):
            rows += [Row("edge", "module", a.asname or a.name, n.lineno, text=a.name) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            base = own[: max(0, len(own) - n.level)] if n.level else []
            module = ".".join([*base, *([n.module] if n.module else [])])
            for a in n.names:
                rows.append(Row("edge", "name", a.name, n.lineno, text=module))
                rows.append(Row("edge", "module", a.name, n.lineno, text=f"{module}.{a.name}" if module else a.name))
    return rows


# --- a lexer for languages with braces --------------------------------------------------


@dataclass
class Token:
    """A word, a mark or a string, with its place."""

    kind: str
    text: str
    at: int
    line: int


_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_RAW = re.compile(r'r(#*)"')


def tokens(text: str, language: str) -> list[Token]:
    """Tokens without comments; what is inside strings can't be taken for code."""
    out: list[Token] = []
    at, line = 0, 1
    nested = language in ("rust", "dart")
    while at < len(text):
        c = text[at]
        end = at + 1
        kind = "mark"
        if c.isspace():
            kind = ""
        elif text.startswith("//", at):
            stop = text.find("\n", at)
            kind, end = "", len(text) if stop < 0 else stop
        elif text.startswith("/*", at):
            kind, depth, end = "", 1, at + 2
            while depth and end < len(text):
                if text.startswith("*/", end):
                    depth, end = depth - 1, end + 2
                elif nested and text.startswith("/*", end):
                    depth, end = depth + 1, end + 2
                else:
                    end += 1
        elif language == "rust" and (m := _RAW.match(text, at)):
            stop = text.find('"' + m[1], m.end())
            kind, end = "string", len(text) if stop < 0 else stop + 1 + len(m[1])
        elif c == "'" and language == "rust" and not re.match(r"'(\\.[^']*|[^\\'])'", text[at : at + 12]):
            kind = "mark"  # a lifetime
        elif c in "\"'" or c == "`" and language == "typescript":
            fence = c * 3 if language == "dart" and text.startswith(c * 3, at) else c
            raw = language == "dart" and out and out[-1].text == "r" and out[-1].at == at - 1
            end = at + len(fence)
            while end < len(text) and not text.startswith(fence, end):
                if len(fence) == 1 and text[end] == "\n" and c != "`" and language != "rust":
                    break
                end += 2 if text[end] == "\\" and not raw else 1
            kind, end = "string", min(len(text), end + len(fence))
        elif m := _WORD.match(text, at):
            kind, end = "word", m.end()
        elif c.isdigit():
            kind, end = "number", re.compile(r"[\w.]+").match(text, at).end()
        elif text.startswith("=>", at) or text.startswith("::", at):
            end = at + 2
        if kind:
            out.append(Token(kind, text[at:end], at, line))
        line += text.count("\n", at, end)
        at = end
    return out


@dataclass
class Statement:
    """Tokens of a top-level statement: its head (up to a block, if it has one), and its block."""

    head: list[Token]
    block: list[Token]
    last: Token

    def source(self, text: str) -> str:
        return text[self.head[0].at : self.last.at + len(self.last.text)]


def statements(toks: list[Token], starts: frozenset[str] = frozenset()) -> Iterator[Statement]:
    """Statements of a run of tokens: each ends at a semicolon or a closing brace of its own level.

    `starts`: words that begin a new statement on a new line even without a
    semicolon before. A closing brace doesn't end a statement that goes on with
    one of ")", ",", ".", ";", "=" or "as" right behind, or that is an assignment.
    """
    head: list[Token] = []
    block: list[Token] = []
    depth, blocked, assigned = 0, False, False
    for i, t in enumerate(toks):
        if depth == 0 and not blocked and head and t.text in starts and t.line > head[-1].line and t.kind == "word" and head[-1].text not in ("=", "=>", "export", "default", "abstract", "async", "declare", ",", "|", "&"):
            yield Statement(head, block, head[-1])
            head, block, assigned = [], [], False
        (block if depth and blocked else head).append(t)
        assigned = assigned or depth == 0 and t.text in ("=", "=>")
        if t.kind == "mark" and t.text in "{([":
            lists_names = head[0].text == "import" or head[0].text == "export" and len(head) == 2
            if t.text == "{" and depth == 0 and not assigned and not lists_names:
                blocked = True
            depth += 1
        elif t.kind == "mark" and t.text in "})]":
            depth = max(0, depth - 1)
            if depth == 0 and t.text == "}" and blocked:
                nxt = toks[i + 1].text if i + 1 < len(toks) else ""
                if nxt not in (")", ",", ".", "="):
                    yield Statement(head, block, t)
                    head, block, blocked, assigned = [], [], False, False
        elif t.kind == "mark" and t.text == ";" and depth == 0:
            if len(head) > 1:
                yield Statement(head, block, t)
            head, block, blocked, assigned = [], [], False, False
    if head:
        yield Statement(head, block, (block or head)[-1])


# --- Rust -------------------------------------------------------------------------------

_RUST = ("fn", "struct", "enum", "trait", "mod", "const", "static", "type", "union", "impl", "macro_rules", "use")
_KEPT = re.compile(r"#\[\s*(cfg|macro_export|derive|no_mangle)\b")


def _attributes(head: list[Token], text: str) -> tuple[list[str], list[Token]]:
    """Attributes in front of an item, and the rest of its head."""
    found = []
    while len(head) > 1 and head[0].text == "#":
        depth, k = 0, 1
        if head[k].text == "!":
            k += 1
        while k < len(head):
            depth += head[k].text == "["
            depth -= head[k].text == "]"
            k += 1
            if depth == 0:
                break
        found.append(_collapsed(text[head[0].at : head[k - 1].at + 1]))
        head = head[k:]
    return found, head


def _rust_item(head: list[Token], text: str) -> tuple[str, str, str]:
    """(kind, name, visibility); an empty kind for anything else."""
    shown, k = "no", 0
    if head and head[0].text == "pub":
        shown, k = "yes", 1
        if len(head) > 1 and head[1].text == "(":
            close = next((i for i, t in enumerate(head) if t.text == ")"), 1)
            shown, k = text[head[0].at : head[close].at + 1], close + 1
    while k < len(head):
        t = head[k]
        if t.text in ("default", "unsafe", "async", "extern") or t.kind == "string" or t.text == "const" and k + 1 < len(head) and head[k + 1].text in ("fn", "unsafe", "async", "extern"):
            k += 1
            continue
        break
    if k >= len(head) or head[k].text not in _RUST:
        return "", "", shown
    kind = head[k].text
    if kind == "impl":
        stop = next((t.at for t in head[k:] if t.text in ("{", ";")), head[-1].at + len(head[-1].text))
        return kind, _collapsed(text[head[k].at : stop]), shown
    name = next((t.text for t in head[k + 1 :] if t.kind == "word" and t.text not in ("mut", "ref")), "?")
    return kind, name, shown


def _use_paths(toks: list[Token]) -> list[str]:
    """Paths that a use tree names: a::{b, c as d} gives a::b and a::c."""
    out: list[str] = []

    def tree(at: int, base: str) -> int:
        path = base
        while at < len(toks):
            t = toks[at].text
            if t == "{":
                at += 1
                while at < len(toks) and toks[at].text != "}":
                    at = tree(at, path)
                    at += at < len(toks) and toks[at].text == ","
                return at + 1
            if t in (",", "}", ";"):
                break
            if t == "as":
                at += 2
                continue
            path += t
            at += 1
        if path != base or not path.endswith("::"):
            out.append(path)
        return at

    tree(0, "")
    return out


def scan_rust(text: str, path: str = "") -> list[Row]:
    """Items of a crate file, also with attributes on their own line or over several."""
    rows: list[Row] = []
    toks = tokens(text, "rust")
    for s in statements(toks):
        found, head = _attributes(s.head, text)
        kind, name, shown = _rust_item(head, text)
        if not kind or kind == "use":
            continue
        rows.append(Row("decl", kind, name, head[0].line, s.last.line, shown))
        rows += [Row("signal", "attribute", start=head[0].line, owner=name, text=a) for a in found if _KEPT.match(a)]
        if kind in ("impl", "trait", "mod"):
            for inner in statements(s.block[1:-1] if s.block and s.block[0].text == "{" else s.block):
                _, h = _attributes(inner.head, text)
                k, n, _ = _rust_item(h, text)
                if k == "fn":
                    rows.append(Row("member", "method", n, h[0].line, inner.last.line, owner=name))
    for i, t in enumerate(toks):
        if t.text == "use" and t.kind == "word" and (i == 0 or toks[i - 1].text in (";", "}", "{", "]", "pub", ")")):
            end = next((k for k in range(i, len(toks)) if toks[k].text == ";"), len(toks) - 1)
            first = i - 1 if i and toks[i - 1].text == "pub" else i
            rows.append(Row("import", start=toks[first].line, end=toks[end].line, text=_collapsed(text[toks[first].at : toks[end].at + 1])))
            for p in _use_paths(toks[i + 1 : end]):
                base, _, name = p.rpartition("::")
                rows.append(Row("edge", "name", name, t.line, text=base))
                rows.append(Row("edge", "module", name, t.line, text=p))
    return rows


# --- Dart -------------------------------------------------------------------------------

_DART_TYPES = {"class": "class", "mixin": "mixin", "enum": "enum", "extension": "extension", "typedef": "type"}
_DART_MODIFIERS = ("abstract", "base", "final", "sealed", "interface", "mixin")
_DART_WIDGETS = {"StatelessWidget": "widget (stateless)", "StatefulWidget": "widget (stateful)", "State": "state", "ConsumerWidget": "widget (ConsumerWidget)", "ConsumerStatefulWidget": "widget (ConsumerStatefulWidget)", "HookWidget": "widget (HookWidget)"}


def _annotated(head: list[Token]) -> list[Token]:
    """A head without annotations."""
    while len(head) > 2 and head[0].text == "@":
        k = 2
        while k + 1 < len(head) and head[k].text == ".":
            k += 2
        if k < len(head) and head[k].text == "(":
            depth = 0
            while k < len(head):
                depth += (head[k].text == "(") - (head[k].text == ")")
                k += 1
                if depth == 0:
                    break
        head = head[k:]
    return head


def _called(head: list[Token]) -> str:
    """Name in front of the first parenthesis, if a word precedes it and no assignment does."""
    for i, t in enumerate(head):
        if t.text == "=":
            return ""
        if t.text == "(":
            k = i - 1
            if k >= 0 and head[k].text == ">":  # type parameters
                depth = 0
                while k >= 0:
                    depth += (head[k].text == ">") - (head[k].text == "<")
                    k -= 1
                    if depth == 0:
                        break
            return head[k].text if k > 0 and head[k].kind == "word" else ""
    return ""


def _dart_item(head: list[Token]) -> tuple[str, str]:
    words = [t.text for t in head if t.kind == "word"]
    k = 0
    while k + 1 < len(words) and words[k] in _DART_MODIFIERS and words[k + 1] in (*_DART_MODIFIERS, "class"):
        k += 1
    if words[k : k + 1] and words[k] in _DART_TYPES and head[0].kind == "word":
        kind, name = _DART_TYPES[words[k]], words[k + 1] if k + 1 < len(words) else "?"
        if kind == "class" and "extends" in words[:-1]:
            kind = _DART_WIDGETS.get(words[words.index("extends") + 1], kind)
        return kind, name
    eq = next((i for i, t in enumerate(head) if t.text == "="), None)
    if words and words[0] in ("const", "final", "var", "late") and eq:
        return "const", head[eq - 1].text
    name = _called(head)
    return ("function", name) if name else ("", "")


def scan_dart(text: str, path: str = "") -> list[Row]:
    """Directives and declarations of a library."""
    rows: list[Row] = []
    folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    for s in statements(tokens(text, "dart")):
        head = _annotated(s.head)
        if not head:
            continue
        if head[0].text in ("import", "export", "part", "library"):
            rows.append(Row("import", head[0].text, start=head[0].line, end=s.last.line, text=_collapsed(s.source(text))))
            uri = next((t.text.strip("'\"") for t in head if t.kind == "string"), "")
            if head[0].text == "part":
                rows.append(Row("signal", "part", start=head[0].line, text=_collapsed(s.source(text))))
            if uri and not uri.startswith("dart:"):
                names = [t.text for i, t in enumerate(head) if t.kind == "word" and "show" in [h.text for h in head[:i]]]
                target = uri.split("/", 1)[-1] if uri.startswith("package:") else _joined(folder, uri)
                rows += [Row("edge", head[0].text, n, head[0].line, text=target) for n in names or ["*"]]
            continue
        kind, name = _dart_item(head)
        if not kind:
            continue
        rows.append(Row("decl", kind, name, head[0].line, s.last.line, "no" if name.startswith("_") else "yes"))
        if s.block and kind not in ("enum", "type", "function", "const"):
            for inner in statements(s.block[1:-1] if s.block[0].text == "{" else s.block):
                h = _annotated(inner.head)
                name_in = _called(h)
                if name_in:
                    rows.append(Row("member", "method", name_in, h[0].line, inner.last.line, owner=name))
    if path.endswith((".g.dart", ".freezed.dart")):
        rows.append(Row("signal", "generated", text=path))
    return rows


def _joined(folder: str, relative: str) -> str:
    """A relative path seen from a folder, without dots."""
    out: list[str] = []
    for part in (folder + relative).split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


# --- TypeScript -------------------------------------------------------------------------

_TS_STARTS = frozenset("import export const let var function class interface type enum abstract declare async namespace".split())
_JSX = re.compile(r"<>|</\s*[A-Za-z>]|<[A-Za-z][\w.]*(?:\s[^<>]*)?/>")
_HOOK = re.compile(r"\b(?:const|let|var)\s+(\[[^\]]*\]|\w+)[^=\n]*=\s*(?:React\.)?(" + "|".join(HOOKS) + r")\b")
_SIGNALS = (("api", re.compile(r"\b(?:fetch|axios(?:\.\w+)?|api\.\w+)\s*\(")), ("event_source", re.compile(r"\bnew\s+EventSource\s*\(")), ("dynamic_class", re.compile(r"className=\{`[^`]*\$\{")))


def scan_typescript(text: str, path: str = "") -> list[Row]:
    """Declarations at the outer level, by scanning and not by a compiler: nested statements without semicolons may end late."""
    rows: list[Row] = []
    folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    for s in statements(tokens(text, "typescript"), _TS_STARTS):
        words = [t.text for t in s.head if t.kind == "word"]
        source = s.source(text)
        start, end = s.head[0].line, s.last.line
        if words[:1] == ["import"] or words[:1] == ["export"] and "from" in words and s.head[-1].kind in ("string", "mark"):
            target = next((t.text.strip("'\"`") for t in reversed(s.head) if t.kind == "string"), "")
            if words[0] == "import":
                rows.append(Row("import", start=start, end=end, text=_collapsed(source)))
            if target.startswith("."):
                stem = re.sub(r"\.(tsx?|jsx?)$", "", _joined(folder, target))
                names = [w for i, w in enumerate(words[1:], 1) if w not in ("from", "type", "as", "default") and words[i - 1] != "as"]
                rows += [Row("edge", "name" if names else "side-effect", n, start, text=stem) for n in names or [""]]
            continue
        exported = "yes" if words[:1] == ["export"] else "no"
        k = 0
        while k < len(words) and words[k] in ("export", "default", "abstract", "declare", "async"):
            k += 1
        kind, name = (words[k], words[k + 1]) if k + 1 < len(words) else ("", "")
        jsx = bool(_JSX.search(source))
        found: list[tuple[str, str]] = []
        if kind in ("type", "interface"):
            found = [("type", name)]
        elif kind in ("class", "enum"):
            found = [(kind, name)]
        elif kind == "function":
            found = [("component" if name[:1].isupper() and jsx else "function", name)]
        elif kind in ("const", "let", "var"):
            if kind == "const" and name == "enum":
                found = [("enum", words[k + 2])]
            else:
                arrow = any(t.text == "=>" for t in s.head) and re.search(r"=\s*(async\s+)?(\(|<|[A-Za-z_$][\w$]*\s*=>)", source) or re.search(r"=\s*(async\s+)?function\b", source)
                found = [("component" if arrow and name[:1].isupper() and jsx else "function" if arrow else "const", name)]
        for kind, name in found:
            rows.append(Row("decl", kind, name, start, end, exported))
            rows += [Row("signal", "hook", m[2], start + source.count("\n", 0, m.start()), owner=name, text=f"{m[2]}: {m[1]}") for m in _HOOK.finditer(source)]
    for kind, pattern in _SIGNALS:
        rows += [Row("signal", kind, start=text.count("\n", 0, m.start()) + 1, text=m[0][:120]) for m in pattern.finditer(text)]
    return rows


SCANNERS = {"python": scan_python, "rust": scan_rust, "dart": scan_dart, "typescript": scan_typescript}


def line_count(text: str, language: str) -> int:
    """Lines of a file; TypeScript counts the empty one behind a final newline."""
    return len(text.split("\n")) if language == "typescript" else len(text.splitlines())


# --- DataFrames -------------------------------------------------------------------------


def inventory(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """All findings in `files`, one row each (see SCHEMA), from one pass over them.

    Files of other languages and pruned folders give nothing; a null text is an
    empty file. Rows are independent; repeated files are scanned as often.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, t in zip(pdf["p"], pdf["t"]):
                language = next((v for k, v in LANGUAGES.items() if p.endswith(k)), None)
                if language is None or any(x in PRUNED for x in p.split("/")):
                    continue
                rows = [Row("file", name=p.rsplit("/", 1)[-1], end=line_count(t or "", language)), *SCANNERS[language](t or "", p)]
                out += [(p, language, r.section, i, r.kind, r.name, r.start, r.end, r.exported, r.owner, r.text) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.where(F.col(path).isNotNull()).select(F.col(path).alias("p"), F.col(text).alias("t")).mapInPandas(scan, SCHEMA)


def module_keys(files: DataFrame) -> DataFrame:
    """(file, language, module): names by which other files import a file; source roots are left out of the second one."""
    p = F.col("file")
    bare = F.regexp_replace(p, r"\.(py|rs|dart|tsx?)$", "")
    rooted = F.regexp_replace(bare, r"^(src|lib)/", "")
    key = F.when(F.col("language") == "python", F.array(*[F.regexp_replace(F.replace(x, F.lit("/"), F.lit(".")), r"\.__init__$", "") for x in (bare, rooted)]))
    key = key.when(F.col("language") == "rust", F.array(*[F.concat(F.lit(pre), F.regexp_replace(F.replace(rooted, F.lit("/"), F.lit("::")), r"::mod$", "")) for pre in ("crate::", "")]))
    key = key.when(F.col("language") == "dart", F.array(p, F.regexp_replace(p, r"^lib/", "")))
    key = key.otherwise(F.array(bare, F.regexp_replace(bare, "/index$", "")))
    return files.select("file", "language", F.explode(F.array_distinct(key)).alias("module"))


def import_edges(found: DataFrame) -> DataFrame:
    """(src_file, target_file, name) of imports among the inventoried files: one equi-join on module names."""
    edges = found.where("section = 'edge'").select(F.col("file").alias("src_file"), "language", F.col("text").alias("module"), "name")
    keys = module_keys(found.where("section = 'file'").select("file", "language"))
    met = edges.join(keys.withColumnRenamed("file", "target_file"), ["language", "module"]).where("src_file <> target_file")
    return met.select("src_file", "target_file", "name").distinct()


def markdown(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, markdown): the inventory of each file as a document with fixed sections."""
    s, seq = F.col("section"), F.col("seq")
    lines = lambda cond, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(seq, line.alias("line"))))), lambda x: x["line"]), "\n")
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    decl = F.concat(F.lit("| "), F.col("kind"), F.lit(" | "), tick(F.col("name")), F.lit(" | "), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(" | "), F.col("exported"), F.lit(" |"))
    note = F.concat(F.lit("- "), F.col("owner"), F.lit(" "), F.col("kind"), F.lit(" "), tick(F.when(s == "member", F.col("name")).otherwise(F.col("text"))))
    doc = found.groupBy("file").agg(F.max(F.when(s == "file", F.col("end"))).alias("n"), lines(s == "import", F.concat(F.lit("- "), tick(F.col("text")))).alias("i"), lines(s == "decl", decl).alias("d"), lines(s.isin("member", "signal"), note).alias("g"))
    by = edges.groupBy(F.col("target_file").alias("file"), "src_file").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    by = by.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), tick(F.col("src_file")), F.lit(" imports: "), F.col("names")))), "\n").alias("by"))
    out = doc.join(by, "file", "left")
    text = F.concat(F.lit("# Inventory: "), F.col("file"), F.lit("\n\nTotal lines: "), F.col("n").cast("string"), F.lit("\n\n## Imports\n\n"), F.col("i"), F.lit("\n\n## Top-level declarations (in order)\n\n| Kind | Name | Lines | Exported |\n|---|---|---|---|\n"), F.col("d"), F.lit("\n\n## Members and signals\n\n"), F.col("g"), F.lit("\n\n## Imported by (load-bearing exports — keep compatible)\n\n"), F.coalesce("by", F.lit("(no other source file imports this module)")), F.lit("\n"))
    return out.select("file", text.alias("markdown"))
