"""Functions on Python source, with the standard library's parser.

Plain functions here; ``column`` turns one into a column function that runs
over Arrow batches. Source is rendered by ast.unparse throughout.
"""

from __future__ import annotations

import ast
import builtins
import io
import re
import tokenize
from collections import Counter, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F


def column(function: Callable, kind: str = "string") -> Callable[..., Column]:
    """A column function of ``function`` over its arguments' values, null where a value is null."""

    def apply(*columns: Column) -> Column:
        @F.pandas_udf(kind)
        def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
            return pd.Series([None if any(v is None for v in values) else function(*values) for values in zip(first, *rest)], dtype=object)

        return run(*columns)

    return apply


def _tree(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError):
        return None


#: Fields that hold statements, or what holds them.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def _statements(tree: ast.AST) -> Iterator[ast.AST]:
    """The tree's statements in the order of ast.walk, without a look at expressions, which hold none."""
    todo = deque([tree])
    while todo:
        node = todo.popleft()
        for name in _BLOCKS:
            held = getattr(node, name, None)
            if isinstance(held, list):
                todo.extend(held)
        yield node


def _function(tree: ast.AST, name: str) -> ast.FunctionDef | None:
    return next((n for n in _statements(tree) if isinstance(n, ast.FunctionDef) and n.name == name), None)


def parseable(source: str) -> bool:
    return _tree(source) is not None


def docstring(source: str, name: str) -> str | None:
    tree = _tree(source)
    found = _function(tree, name) if tree else None
    return ast.get_docstring(found) if found else None


def replaced_docstring(source: str, name: str, text: str) -> str:
    """Source whose functions of that name begin with ``text`` instead of their first statement."""
    tree = ast.parse(source)
    for node in _statements(tree):
        if isinstance(node, ast.FunctionDef) and node.name == name:
            node.body[0] = ast.Expr(ast.Constant(text))
    return ast.unparse(tree)


def updated_docstring(source: str, instruction: str) -> str:
    """Every documented function gets the instruction followed by its old examples."""
    tree = ast.parse(source)
    for node in _statements(tree):
        if isinstance(node, ast.FunctionDef) and (old := ast.get_docstring(node)):
            examples = [f"    {line}" for line in old.split("\n") if line.strip().startswith(">>>")]
            text = instruction.strip() + ("\n" + "\n".join(examples) + "\n    " if examples else "")
            node.body[0] = ast.Expr(ast.Constant(text))
    return ast.unparse(tree)


def without_docstrings(source: str) -> tuple[dict[str, str], str]:
    """Docstrings by function name, and the source without them."""
    tree, found = ast.parse(source), {}
    for node in _statements(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(node) is not None:
            found[node.name] = ast.get_docstring(node)
            node.body = node.body[1:] or [ast.Pass()]
    return found, ast.unparse(tree)


def hoisted_imports(source: str) -> str:
    """All imports, wherever they stand, before everything else."""
    moved: list[ast.stmt] = []

    def lift(node: ast.AST) -> None:
        for name in _BLOCKS:
            held = getattr(node, name, None)
            if not isinstance(held, list):
                continue
            kept = []
            for child in held:
                if isinstance(child, (ast.Import, ast.ImportFrom)):
                    moved.append(child)
                else:
                    lift(child)
                    kept.append(child)
            held[:] = kept
        if isinstance(getattr(node, "body", None), list) and not node.body and not isinstance(node, ast.Module):
            node.body = [ast.Pass()]

    tree = ast.parse(source)
    lift(tree)
    tree.body = moved + tree.body
    return ast.unparse(tree)


def split_function(source: str, name: str | None = None) -> tuple[str, str] | None:
    """(text through the signature, body) of the named top-level function, or of the last; None without one."""
    tree = _tree(source)
    found = [n for n in tree.body if isinstance(n, ast.FunctionDef) and name in (None, n.name)] if tree else []
    if not found:
        return None
    lines, node = source.splitlines(keepends=True), found[-1]
    at = node.body[0].lineno - 1
    end = node.end_lineno
    return "".join(lines[:at]), "".join(lines[at:end])


def function_names(source: str) -> list[str]:
    """Functions defined, without names of builtins unless nothing else is left."""
    tree = _tree(source)
    names = [n.name for n in _statements(tree) if isinstance(n, ast.FunctionDef)] if tree else []
    own = [n for n in names if not hasattr(builtins, n)]
    return own or names


def parameters(source: str, name: str) -> list[str]:
    tree = _tree(source)
    found = _function(tree, name) if tree else None
    return [a.arg for a in found.args.args] if found else []


def literal(node: ast.AST):
    try:
        return ast.literal_eval(node)
    except (ValueError, TypeError, SyntaxError):
        return None


def calls(source: str, name: str) -> list[ast.Call]:
    tree = _tree(source)
    return [n for n in ast.walk(tree) if isinstance(n, ast.Call) and getattr(n.func, "id", getattr(n.func, "attr", None)) == name] if tree else []


def call_arguments(source: str, name: str) -> list[str]:
    """repr of the tuple of literal arguments of each call; arguments that are no literals are left out."""
    return [repr(tuple(v for a in c.args if (v := literal(a)) is not None)) for c in calls(source, name)]


def tested_inputs(source: str, name: str) -> list[str] | None:
    """First argument of each call, as a literal's repr or else as source; None without calls."""
    out = []
    for c in calls(source, name):
        if c.args:
            value = literal(c.args[0])
            out.append(repr(value) if value is not None else ast.unparse(c.args[0]))
    return out or None


def imports_and_asserts(source: str) -> tuple[list[str], list[str]]:
    tree = _tree(source)
    if tree is None:
        return [], []
    imports = [ast.unparse(n) for n in _statements(tree) if isinstance(n, (ast.Import, ast.ImportFrom))]
    asserts = [ast.unparse(a) for n in _statements(tree) if isinstance(n, ast.If) for a in n.body if isinstance(a, ast.Assert)]
    return imports, asserts


def is_tuple(text: str) -> bool:
    try:
        return isinstance(ast.literal_eval(text), tuple)
    except (ValueError, SyntaxError):
        return False


def type_name(value) -> str:
    def kinds(values):
        return ", ".join(sorted({type_name(v) for v in values}))

    if isinstance(value, (list, set)):
        return f"{type(value).__name__} of {kinds(value)}"
    if isinstance(value, dict):
        return f"dict of {kinds(value)} to {kinds(value.values())}"
    return type(value).__name__


def described(inputs: list[str], single: bool = True) -> list[list[str]]:
    """Types of each input's arguments; a bare value is one argument if ``single``."""
    out = []
    for text in inputs:
        value = ast.literal_eval(text)
        values = value if isinstance(value, tuple) else (value,) if single else value
        out.append([type_name(v) for v in values])
    return out


def checker(inputs: list[str], outputs: list[str], entry: str, pattern: str) -> str:
    """The template's text with input tuples, outputs and the function's name filled in."""
    given = [v if isinstance(v := ast.literal_eval(x), tuple) else (v,) for x in inputs]
    slots = {"input_list": repr(given), "output_list": repr([ast.literal_eval(x) for x in outputs]), "func_entry": entry}
    return re.sub(r"\{(input_list|output_list|func_entry)\}", lambda m: slots[m[1]], pattern)


_ANY_LINES, _ONE_LINE = re.compile(r"\(.*?\)\n\s*[^>\n]+", re.S), re.compile(r"\(([^\n]+)\)\n(\s*[^>\n]+)")
_BLANKS = re.compile(r"\s*")


def _examples(doc: str, entry: str, call: re.Pattern) -> Iterator[tuple[int, int, re.Match]]:
    """Start, end and match of each ``>>> entry`` that ``call`` goes on from. The name is compared, because a pattern with it would be compiled for every row."""
    at = doc.find(">>>")
    while at >= 0:
        name = _BLANKS.match(doc, at + 3).end()
        found = call.match(doc, name + len(entry)) if doc.startswith(entry, name) else None
        if found:
            yield at, found.end(), found
        at = doc.find(">>>", found.end() if found else at + 1)


def instruction_and_examples(doc: str | None, entry: str) -> tuple[str, str]:
    """A docstring without its function's examples on one line, and the examples rendered anew."""
    if doc is None:
        return "", ""
    bare, at = [], 0
    for first, last, _ in _examples(doc, entry, _ANY_LINES):
        bare.append(doc[at:first])
        at = last
    bare = "".join([*bare, doc[at:]]).replace("\n", "").strip()
    shown = [(m[1].strip(), m[2].strip()) for _, _, m in _examples(doc, entry, _ONE_LINE)]
    return bare, "\n".join(f"    >>>{entry}({a})\n    {b}" for a, b in shown)


_COMMENT = re.compile(r"""//.*?$|/\*.*?\*/|'(?:\\.|[^\\'])*'|"(?:\\.|[^\\"])*\"""", re.S | re.M)


def without_comments(source: str, language: str) -> str:
    """Source without comments (and, in Python, docstrings) and empty lines; Ruby is returned as it is."""
    if language == "ruby":
        return source
    if language != "python":
        bare = _COMMENT.sub(lambda m: " " if m[0].startswith("/") else m[0], source)
        return "\n".join(x for x in bare.split("\n") if x.strip())
    out, line, at, last = [], 1, 0, tokenize.INDENT
    for kind, text, (l1, c1), (l2, c2), _ in tokenize.generate_tokens(io.StringIO(source).readline):
        if l1 > line:
            at = 0
        if c1 > at:
            out.append(" " * (c1 - at))
        doc = kind == tokenize.STRING and last in (tokenize.INDENT, tokenize.NEWLINE, tokenize.NL, tokenize.DEDENT, tokenize.ENCODING)
        if kind != tokenize.COMMENT and not (doc and c1 >= 0 and last != tokenize.NL):
            out.append(text)
        last, line, at = kind, l2, c2
    return "\n".join(x for x in "".join(out).split("\n") if x.strip())


def subtrees(source: str) -> list[str]:
    """S-expressions of node kinds for the root and every inner node."""
    tree = _tree(source)
    if tree is None:
        return []

    def shape(node) -> str:
        own = [shape(c) for c in ast.iter_child_nodes(node) if not isinstance(c, ast.expr_context)]
        return f"({type(node).__name__}{''.join(' ' + x for x in own)})"

    return [shape(n) for n in ast.walk(tree) if n is tree or any(not isinstance(c, ast.expr_context) for c in ast.iter_child_nodes(n))]


def syntax_match(reference: str, hypothesis: str) -> float:
    """Share of the reference's subtrees that occur in the hypothesis; a subtree may match repeatedly."""
    own, other = subtrees(reference), set(subtrees(hypothesis))
    return sum(t in other for t in own) / len(own) if own else 0.0


def data_flow(source: str) -> list[tuple[str, int, str, tuple[str, ...], tuple[int, ...]]]:
    """Edges (variable, place, relation, sources, their places) in order of place.

    Places number the names of the source from left to right. Assignments give
    computedFrom edges to what their values read, reads comesFrom edges to the
    last definitions. The states of branches merge; loops run twice.
    """
    tree = _tree(source)
    if tree is None:
        return []
    spots = sorted({(n.lineno, n.col_offset, n.id if isinstance(n, ast.Name) else n.arg) for n in ast.walk(tree) if isinstance(n, (ast.Name, ast.arg))})
    place = {(l, c): i for i, (l, c, _) in enumerate(spots)}
    edges: set = set()

    def at(node):
        return place[(node.lineno, node.col_offset)]

    def reads(node, state):
        found = []
        for n in ast.walk(node):
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
                p = at(n)
                known = tuple(sorted(state.get(n.id, ())))
                edges.add((n.id, p, "comesFrom", (n.id,) if known else (), known))
                found.append((p, n.id))
        return sorted(found)

    def writes(target, sources, state):
        for n in ast.walk(target):
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                edges.add((n.id, at(n), "computedFrom", tuple(v for _, v in sources), tuple(p for p, _ in sources)))
                state[n.id] = {at(n)}

    def merged(states):
        out: dict[str, set[int]] = {}
        for s in states:
            for k, v in s.items():
                out[k] = out.get(k, set()) | v
        return out

    def block(body, state):
        for node in body:
            state = statement(node, state)
        return state

    def statement(node, state):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            inner = dict(state)
            for a in node.args.args:
                edges.add((a.arg, at(a), "comesFrom", (), ()))
                inner[a.arg] = {at(a)}
            for d in node.args.defaults:
                reads(d, state)
            return merged([state, block(node.body, inner)])
        if isinstance(node, ast.Assign):
            sources = reads(node.value, state)
            for t in node.targets:
                writes(t, sources, state)
        elif isinstance(node, ast.AugAssign):
            sources = reads(node.value, state)
            if isinstance(node.target, ast.Name):
                sources = sorted([*sources, *((p, node.target.id) for p in state.get(node.target.id, ()))])
            writes(node.target, sources, state)
        elif isinstance(node, ast.AnnAssign):
            if node.value is not None:
                writes(node.target, reads(node.value, state), state)
        elif isinstance(node, ast.If):
            reads(node.test, state)
            taken = block(node.body, dict(state))
            state = merged([taken, block(node.orelse, dict(state)) if node.orelse else state])
        elif isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
            for _ in range(2):
                if isinstance(node, ast.While):
                    reads(node.test, state)
                else:
                    writes(node.target, reads(node.iter, state), state)
                state = merged([state, block(node.body, dict(state))])
            state = block(node.orelse, state)
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            for item in node.items:
                sources = reads(item.context_expr, state)
                if item.optional_vars is not None:
                    writes(item.optional_vars, sources, state)
            state = block(node.body, state)
        elif isinstance(node, ast.Try):
            state = merged([block(node.body, dict(state)), *(block(h.body, dict(state)) for h in node.handlers)])
            state = block(node.finalbody, block(node.orelse, state))
        elif isinstance(node, ast.ClassDef):
            state = block(node.body, state)
        else:
            reads(node, state)
        return state

    block(tree.body, {})
    return pruned(edges)


def pruned(edges) -> list:
    """Edges merged by place, without names that neither have sources nor are any.

    Names and places of sources are lists of their own: one name may come from several places.
    """
    by_place: dict = {}
    for name, p, how, names, places in sorted(edges, key=lambda e: (e[1], e[2], e[4], e[3])):
        if (name, p, how) in by_place:
            old_names, old_places = by_place[(name, p, how)]
            names = tuple(dict.fromkeys((*old_names, *names)))
            places = tuple(sorted({*old_places, *places}))
        by_place[(name, p, how)] = (names, places)
    used = {q for _, places in by_place.values() for q in places} | {p for (_, p, _), (_, places) in by_place.items() if places}
    return sorted(((n, p, how, names, places) for (n, p, how), (names, places) in by_place.items() if p in used), key=lambda e: (e[1], e[2]))


def normalised_flow(edges: list) -> list[tuple[str, str, tuple[str, ...]]]:
    """Edges with variables renamed by first appearance, sources before targets."""
    names: dict[str, str] = {}
    out = []
    for name, _, how, sources, _ in sorted(edges, key=lambda e: e[1]):
        for s in (*sources, name):
            names.setdefault(s, f"var_{len(names)}")
        out.append((names[name], how, tuple(names[s] for s in sources)))
    return out


def flow_match(reference: str, hypothesis: str) -> float:
    """Share of the reference's normalised edges met in the hypothesis, each at most once; 0 without edges."""
    own, other = (Counter(normalised_flow(data_flow(x))) for x in (reference, hypothesis))
    return (own & other).total() / own.total() if own else 0.0


def first_function(prompt: str) -> tuple[str, str]:
    """Name of the last function that a prompt begins, and what stands before it."""
    found = list(re.finditer(r"^def\s+(\w+)\s*\(", prompt, re.M))
    return (found[-1][1], prompt[: found[-1].start()]) if found else ("", prompt)


#: How a function begins in the languages that generations come in, and whether a brace ends it.
FUNCTION_HEADS = {
    "python": (r"def\s+{}\s*\(", False), "java": (r"[\w<>\[\], ]+\s+{}\s*\(", True), "cpp": (r"[\w<>:&*, ]+\s+{}\s*\(", True), "cs": (r"[\w<>\[\], ]+\s+{}\s*\(", True),
    "js": (r"(?:const\s+|function\s+){}\b", True), "ts": (r"(?:const\s+|function\s+){}\b", True), "php": (r"function\s+{}\s*\(", True), "sh": (r"{}\s*\(\s*\)", True),
}


def generation(output: str, prompt: str, name: str, language: str) -> str:
    """The function in a chat's output: its first fenced block cut before a main, from the function to its end.

    A brace language's function ends at the first line that is a closing brace
    at the indentation of its head; without the function the answer is the
    prompt followed by the output.
    """
    head, brace = FUNCTION_HEADS[language]
    fence = re.search(r"```[^\n]*\n(.*?)(?:```|\Z)", output, re.S)
    code = fence[1] if fence else output
    main = re.search(r"^(?:if __name__|int main\b|.*\bstatic void [Mm]ain\b)", code, re.M)
    code = code[: main.start()] if main else code
    found = re.search(rf"^([ \t]*)({head.format(re.escape(name))})", code, re.M)
    if not found:
        return prompt + output
    body = code[found.start() :]
    if brace:
        end = re.search(rf"^{found[1]}\}}[;)]*\s*$", body, re.M)
        return body[: end.end()].rstrip() if end else body.rstrip() + "\n}"
    lines = body.split("\n")
    for i, line in enumerate(lines[1:], 1):
        if line.strip() and not line.startswith((" ", "\t", "#", ")")) :
            return "\n".join(lines[:i]).rstrip()
    return body.rstrip()
