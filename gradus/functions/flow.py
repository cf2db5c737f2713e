"""Data flow of source code: an interpreter over syntax trees with one table of rules a language.

An edge is (name, place, relation, sources, their places); places number all tokens. A name that is read
comesFrom the places that may have defined it, or defines itself if none has; what is
written is computedFrom (in declarations: comesFrom) the names of its value. Python has the standard library's
parser (``code``); the other six differ as ``RULES`` says:

* java, c_sharp and ruby add the state before a branch only where there is no else, go, php and javascript always;
* plain assignments of javascript and short declarations of go only read their names;
* loops over elements run twice where the language's table has them (java, c_sharp, php, ruby's for), loops of
  a header once, and once more what follows the declaration in it (its update, in go).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

from . import syntax
from .syntax import Node

#: Names under which languages are asked for.
LANGUAGES = {"java": "java", "js": "javascript", "javascript": "javascript", "c_sharp": "c_sharp", "cs": "c_sharp", "php": "php", "go": "go", "python": "python", "ruby": "ruby"}


@dataclass(frozen=True)
class Rules:
    """Kinds of nodes by what they do."""

    defines: dict[str, tuple[str, str]] = field(default_factory=dict)  # name and value fields; '' by position
    assigns: tuple[str, ...] = ()
    updates: tuple[str, ...] = ()
    branches: tuple[str, ...] = ()
    always: bool = False  # the state before a branch counts, else or not
    apart: bool = False  # only branches of a branch start from the state before it, wherever they stand
    headers: dict[str, tuple[str, str]] = field(default_factory=dict)  # the child after which all is read again, its field read first
    elements: dict[str, tuple[str, str]] = field(default_factory=dict)  # written and read fields; '' by position
    twice: tuple[str, ...] = ()


#: What each language's nodes do.
RULES = {
    "java": Rules({"variable_declarator": ("name", "value")}, ("assignment_expression",), ("update_expression",), ("if_statement", "else"), headers={"for_statement": ("local_variable_declaration", "")}, elements={"enhanced_for_statement": ("name", "value")}, twice=("while_statement",)),
    "c_sharp": Rules({"variable_declarator": ("", "")}, ("assignment_expression",), ("postfix_unary_expression",), ("if_statement", "else"), headers={"for_statement": ("local_variable_declaration", "")}, elements={"for_each_statement": ("left", "right")}, twice=("while_statement",)),
    "javascript": Rules({"variable_declarator": ("name", "value")}, ("assignment_pattern", "augmented_assignment_expression"), ("update_expression",), ("if_statement", "else"), True, headers={"for_statement": ("variable_declaration", "")}, twice=("while_statement",)),
    "php": Rules({"simple_parameter": ("name", "default_value")}, ("assignment_expression", "augmented_assignment_expression"), ("update_expression",), ("if_statement", "else_clause"), True, headers={"for_statement": ("assignment_expression", "")}, elements={"foreach_statement": ("", "")}, twice=("while_statement",)),
    "go": Rules({"var_spec": ("name", "value")}, ("assignment_statement",), ("inc_statement",), ("if_statement", "else"), True, headers={"for_statement": ("for_clause", "update")}),
    "ruby": Rules({"keyword_parameter": ("name", "value")}, ("assignment", "operator_assignment"), (), ("if", "elsif", "else", "unless", "when"), apart=True, elements={"for": ("pattern", "value")}, twice=("while_modifier", "until")),
}
State = dict[str, tuple[int, ...]]
#: A worker keeps what it read of so many sources of at most so many characters: a task's reference recurs with each of its samples.
RECENT, SHORT = 1024, 1024


def _names(node: Node | None) -> list[Node]:
    """The tokens that may name variables: all but words and signs."""
    return [x for x in node.leaves() if x.named] if node else []


class Flow:
    """Reads one tree and gathers its edges; a state maps names to the places that may have defined them."""

    def __init__(self, language: str):
        self.language, self.rules, self.edges = language, RULES[language], []

    def edge(self, node: Node, how: str, sources=(), places=()) -> None:
        self.edges.append((node.text, node.place, how, tuple(sources), tuple(places)))

    def visit(self, node: Node | None, state: State) -> State:
        """The state after a node."""
        if node is None:
            return state
        r, kind = self.rules, node.kind
        if node.text is not None:
            return self.read(node, state)
        if kind in r.defines:
            return self.define(node, *self.fields(node, *r.defines[kind]), state)
        if kind in r.assigns:
            return self.assign(node, state)
        if kind in r.updates:
            own = _names(node)
            return self.written(own, own, "computedFrom", state)
        if kind in r.branches:
            return self.branch(node, state)
        if kind in r.headers:
            return self.header(node, *r.headers[kind], state)
        if kind in r.elements:
            target, value = self.fields(node, *r.elements[kind])
            for _ in range(2):
                state = self.written(_names(target), _names(value), "computedFrom", self.visit(value, state))
                state = self.visit(node.fields.get("body"), state)
            return state
        for _ in range(2 if kind in r.twice else 1):
            state = self.each(node.children, state)
        return state

    def each(self, nodes, state: State) -> State:
        for child in nodes:
            state = self.visit(child, state)
        return state

    def fields(self, node: Node, first: str, second: str) -> tuple[Node | None, Node | None]:
        """A node's two parts by field; by position where they have no names: a declarator's children, and the last two variables of a loop's head, source first."""
        if first:
            return node.fields.get(first), node.fields.get(second)
        if node.kind in self.rules.elements:
            found = [c for c in node.children if c.kind == "variable_name"]
            return (found[1], found[0]) if len(found) > 1 else (None, found[0] if found else None)
        return node.children[0], node.children[1] if len(node.children) == 2 else None

    def read(self, node: Node, state: State) -> State:
        if not node.named:
            return state
        known = state.get(node.text)
        self.edge(node, "comesFrom", (node.text,) if known else (), known or ())
        return state if known or node.kind != "identifier" else {**state, node.text: (node.place,)}

    def written(self, targets: list[Node], sources: list[Node], how: str, state: State) -> State:
        for x in targets:
            if sources:
                self.edge(x, how, (s.text for s in sources), (s.place for s in sources))
            state = {**state, x.text: (x.place,)}
        return state

    def define(self, node: Node, name: Node | None, value: Node | None, state: State) -> State:
        own = _names(name)
        if value is None:
            for x in own:
                self.edge(x, "comesFrom")
            return state | {x.text: (x.place,) for x in own}
        return self.written(own, _names(value), "comesFrom", self.visit(value, state))

    def assign(self, node: Node, state: State) -> State:
        left, right = node.fields.get("left"), node.fields.get("right")
        pairs = [(left, right)]
        if left and right and self.rules.apart and node.kind != "operator_assignment":
            # As many targets as values: each from its own.
            lists = [[c for c in x.children if c.kind != ","] if x.kind.endswith("_list") else [x] for x in (left, right)]
            pairs = list(zip(*lists)) if len(lists[0]) == len(lists[1]) else pairs
        for _, value in pairs:
            state = self.visit(value, state)
        for target, value in pairs:
            state = self.written(_names(target), _names(value), "computedFrom", state)
        return state

    def branch(self, node: Node, state: State) -> State:
        current, others = state, []
        parted = False
        for child in node.children:
            own = child.kind in self.rules.branches
            if own and not self.rules.apart:
                parted = True
            if child.text is not None and not child.named:
                continue
            if own or parted:
                others.append(self.visit(child, state))
            else:
                current = self.visit(child, current)
        whole = "else" in node.kind or any("else" in c.kind for c in node.children)
        return _merged([*others, current, *([state] if self.rules.always or not whole else [])])

    def header(self, node: Node, mark: str, first: str, state: State) -> State:
        state = self.each(node.children, state)
        at = next((i for i, c in enumerate(node.children) if c.kind == mark), None)
        if at is None:
            return state
        return self.each(node.children[at + 1 :], self.visit(node.children[at].fields.get(first), state))


def _merged(states: list[State]) -> State:
    out: dict[str, set[int]] = {}
    for s in states:
        for k, v in s.items():
            out.setdefault(k, set()).update(v)
    return {k: tuple(sorted(v)) for k, v in out.items()}


def data_flow(source: str, language: str) -> list:
    """Edges in the order of their places, without names that neither have sources nor are any."""
    return list((_recent_flow if len(source) <= SHORT else _data_flow)(source, LANGUAGES[language]))


def _data_flow(source: str, language: str) -> list:
    from .code import data_flow as python_flow, pruned

    if language == "python":
        return python_flow(source)
    flow = Flow(language)
    try:
        flow.visit(syntax.parsed(source, language), {})
    except RecursionError:  # nested beyond any program
        return []
    return pruned(flow.edges)


def subtrees(source: str, language: str) -> list[str]:
    """What stands for each inner node of the source's tree; equal ones have equal shapes."""
    return list((_recent_subtrees if len(source) <= SHORT else _subtrees)(source, LANGUAGES[language]))


def _subtrees(source: str, language: str) -> list[str]:
    from .code import subtrees as python_subtrees

    if language == "python":
        return python_subtrees(source)
    tree = syntax.parsed(source, language)
    return syntax.subtrees(tree) if tree.children else []


@lru_cache(maxsize=RECENT)
def _recent_flow(source: str, language: str) -> tuple:
    return tuple(_data_flow(source, language))


@lru_cache(maxsize=RECENT)
def _recent_subtrees(source: str, language: str) -> tuple:
    return tuple(_subtrees(source, language))


def matched(kind: Callable[[str, str], list], normal: Callable[[list], list], clipped: bool) -> Callable[[str, list[str], str], tuple[int, int]]:
    """(hits, total) of the references' items in the hypothesis, each item of the hypothesis at most once if ``clipped``."""

    def count(hypothesis: str, references: list[str], language: str) -> tuple[int, int]:
        hits = total = 0
        other = Counter(normal(kind(hypothesis, language)))
        for reference in references:
            own = Counter(normal(kind(reference, language)))
            total += own.total()
            hits += sum(min(k, other[x]) if clipped else k for x, k in own.items() if x in other)
        return hits, total

    return count


@lru_cache(maxsize=1)
def counters() -> tuple:
    """The counts of syntax and of data flow."""
    from .code import normalised_flow

    return matched(subtrees, list, False), matched(data_flow, normalised_flow, True)
