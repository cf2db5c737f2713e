"""Concrete syntax trees of java, c_sharp, javascript, php, go and ruby.

A language is a table: its rules (``GRAMMARS``), the names of its expressions (``KINDS``) and how
lines end. One reader runs them all: rules are ordered choices with remembered
results, expressions follow operator precedence. What no rule reads becomes an
``ERROR`` node up to the next end of a statement, so every text has a tree and every token is in it once.

In rules, ``'x'`` is a word or sign, ``f=x`` names a child, ``[x]`` may be missing, ``{x}`` repeats,
``!x`` and ``&x`` look ahead, and rules that begin with ``_`` give their children to the rule
that uses them. ``END`` is a semicolon, or a line's end where the language has that.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache


class Node:
    """A rule's children, or one token (text); places number tokens."""

    __slots__ = ("children", "fields", "kind", "place", "text")

    def __init__(self, kind: str, children=(), fields=None, text: str | None = None, place: int = -1):
        self.kind, self.children, self.fields, self.text, self.place = kind, children, fields or {}, text, place

    @property
    def named(self) -> bool:
        return self.kind != self.text

    def leaves(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.text is not None:
                yield node
            stack.extend(reversed(node.children))


_COMMON = """
parenthesized_expression: '(' _expr ')'
while_statement: 'while' condition=parenthesized_expression body=_statement
do_statement: 'do' body=_statement 'while' condition=parenthesized_expression END
return_statement: 'return' [!END _exprs] END
throw_statement: 'throw' [!END _expr] END
break_statement: 'break' [!END id] END
continue_statement: 'continue' [!END id] END
finally_clause: 'finally' _block
try_statement: 'try' body=_block {catch_clause} [finally_clause]
switch_statement: 'switch' condition=parenthesized_expression body=switch_body
switch_body: '{' {switch_group} '}'
switch_group: switch_label {switch_label} _items
switch_label: 'case' _expr ':' | 'default' ':'
expression_statement: _exprs END
empty_statement: ';'
_exprs: _expr {',' _expr}
argument_list: '(' [_argument {',' _argument} [',']] ')'
_argument: _expr
_block: block
block: '{' _items '}'
_flow: if_statement | while_statement | do_statement | for_statement | return_statement | throw_statement | break_statement | continue_statement | try_statement | switch_statement | empty_statement
"""
_TYPED = """
modifier: 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'synchronized' | 'readonly' | 'const' | 'override' | 'virtual' | 'async' | 'sealed' | 'internal'
if_statement: 'if' condition=parenthesized_expression consequence=_statement ['else' alternative=_statement]
primitive_type: 'int' | 'long' | 'short' | 'byte' | 'char' | 'double' | 'float' | 'boolean' | 'bool' | 'void' | 'string' | 'object' | 'decimal' | 'uint' | 'ulong'
type_arguments: '<' [_type_argument {',' _type_argument}] '>'
_type_argument: wildcard | _type
wildcard: '?' [('extends' | 'super') _type]
_named_type: primitive_type | generic_type | type_id
generic_type: type_id type_arguments
scoped_type: type_id '.' type_id {'.' type_id} [type_arguments]
array_type: (scoped_type | _named_type) dimension {dimension}
nullable_type: (scoped_type | _named_type) '?'
dimension: '[' {','} ']'
_type: array_type | nullable_type | scoped_type | _named_type
formal_parameters: '(' [formal_parameter {',' formal_parameter}] ')'
formal_parameter: {modifier} type=_type ['...'] name=id {dimension} ['=' _expr]
class_declaration: {modifier} ('class' | 'interface' | 'struct' | 'enum') name=id [type_arguments] {!'{' _any} body=class_body
class_body: '{' _items '}'
method_declaration: {modifier} [type_arguments] type=_type name=id [type_arguments] parameters=formal_parameters {'throws' _type} (body=_block | END)
constructor_declaration: modifier {modifier} name=id parameters=formal_parameters body=_block
namespace_declaration: 'namespace' type_id {'.' type_id} body=block
import_declaration: ('import' | 'using' | 'package' | 'namespace') type_id {'.' (type_id | '*')} END
lambda_expression: (id | formal_parameters | inferred_parameters) ('->' | '=>') (_block | _expr)
inferred_parameters: '(' [id {',' id}] ')'
array_initializer: '{' [(array_initializer | _expr) {',' (array_initializer | _expr)}] [','] '}'
_init: array_initializer | _expr
object_creation_expression: 'new' _type argument_list [class_body]
array_creation_expression: 'new' (scoped_type | _named_type) {'[' [_expr] ']'} [array_initializer]
cast_expression: '(' primitive_type ')' _unary | '(' _type ')' &_word _unary
_special: lambda_expression | object_creation_expression | array_creation_expression | cast_expression
_word: id | number | string
"""
#: Rules by language; those of a later text replace the same names of an earlier one.
GRAMMARS = {
    "java": _COMMON + _TYPED + """
program: _items
catch_clause: 'catch' '(' {modifier} _type {'|' _type} id ')' body=_block
for_statement: 'for' '(' (local_variable_declaration | [_exprs] ';') [condition=_expr] ';' [update=_exprs] ')' body=_statement
enhanced_for_statement: 'for' '(' {modifier} type=_type name=id ':' value=_expr ')' body=_statement
local_variable_declaration: {modifier} type=_type variable_declarator {',' variable_declarator} END
variable_declarator: name=id {dimension} ['=' value=_init]
_statement: block | enhanced_for_statement | _flow | import_declaration | class_declaration | method_declaration | constructor_declaration | local_variable_declaration | expression_statement
""",
    "c_sharp": _COMMON + _TYPED + """
compilation_unit: _items
catch_clause: 'catch' ['(' _type [id] ')'] body=_block
for_statement: 'for' '(' [variable_declaration | _exprs] ';' [condition=_expr] ';' [update=_exprs] ')' body=_statement
for_each_statement: 'foreach' '(' type=_type left=id 'in' right=_expr ')' body=_statement
local_declaration_statement: {modifier} variable_declaration END
variable_declaration: type=_type variable_declarator {',' variable_declarator}
variable_declarator: id [equals_value_clause]
equals_value_clause: '=' _init
_statement: block | for_each_statement | _flow | namespace_declaration | import_declaration | class_declaration | method_declaration | constructor_declaration | local_declaration_statement | expression_statement
""",
    "javascript": _COMMON + """
program: _items
_block: statement_block
statement_block: '{' _items '}'
if_statement: 'if' condition=parenthesized_expression consequence=_statement ['else' alternative=_statement]
catch_clause: 'catch' ['(' _pattern ')'] body=_block
for_statement: 'for' '(' (variable_declaration | lexical_declaration | [_exprs] ';') [condition=_exprs] ';' [increment=_exprs] ')' body=_statement
for_in_statement: 'for' '(' ['let' | 'const' | 'var'] left=_pattern ('in' | 'of') right=_expr ')' body=_statement
variable_declaration: 'var' variable_declarator {',' variable_declarator} END
lexical_declaration: ('let' | 'const') variable_declarator {',' variable_declarator} END
variable_declarator: name=_pattern ['=' value=_expr]
array_pattern: '[' [_element {',' _element}] ']'
object_pattern: '{' [_entry {',' _entry}] '}'
_entry: pair_pattern | _element
pair_pattern: key=property_id ':' value=_element
rest_pattern: '...' _pattern
_pattern: array_pattern | object_pattern | rest_pattern | id
_element: assignment_pattern | _pattern
assignment_pattern: left=_pattern '=' right=_expr
formal_parameters: '(' [_element {',' _element}] ')'
function_declaration: ['async'] 'function' ['*'] name=id parameters=formal_parameters body=_block
function: ['async'] 'function' ['*'] [name=id] parameters=formal_parameters body=_block
arrow_function: ['async'] (parameter=id | parameters=formal_parameters) '=>' body=(_block | _expr)
class_declaration: 'class' name=id ['extends' _expr] body=class_body
class_body: '{' {method_definition | ';'} '}'
method_definition: ['static'] ['async'] name=property_id parameters=formal_parameters body=_block
object: '{' [_member {',' _member} [',']] '}'
_member: method_definition | pair | spread_element | id
pair: key=(property_id | string | number) ':' value=_expr
spread_element: '...' _expr
_argument: spread_element | _expr
array: '[' [_argument {',' _argument} [',']] ']'
new_expression: 'new' constructor=id {'.' property_id} [arguments=argument_list]
import_statement: 'import' {!END _any} END
export_statement: 'export' ['default'] _statement
_special: arrow_function | function | new_expression | object | array
_statement: statement_block | for_in_statement | _flow | import_statement | export_statement | class_declaration | function_declaration | variable_declaration | lexical_declaration | expression_statement
""",
    "php": _COMMON + """
program: _items
_block: compound_statement
compound_statement: '{' _items '}'
if_statement: 'if' condition=parenthesized_expression body=_statement {else_if_clause} [else_clause]
else_if_clause: 'elseif' condition=parenthesized_expression body=_statement
else_clause: 'else' body=_statement
catch_clause: 'catch' '(' name {'|' name} [variable_name] ')' body=_block
for_statement: 'for' '(' [_exprs] ';' [_exprs] ';' [_exprs] ')' _statement
foreach_statement: 'foreach' '(' _expr 'as' [variable_name '=>'] ['&'] variable_name ')' body=_statement
echo_statement: 'echo' _exprs END
variable_name: '$' name
formal_parameters: '(' [simple_parameter {',' simple_parameter}] ')'
simple_parameter: [type=_type] ['&'] ['...'] name=variable_name ['=' default_value=_expr]
_type: named_type | optional_type
named_type: name {'\\\\' name}
optional_type: '?' named_type
visibility_modifier: 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'final'
function_definition: {visibility_modifier} 'function' ['&'] name=name parameters=formal_parameters [':' _type] (body=_block | END)
property_declaration: visibility_modifier {visibility_modifier} variable_name ['=' _expr] END
class_declaration: {visibility_modifier} ('class' | 'interface' | 'trait') name=name {!'{' _any} body=declaration_list
declaration_list: '{' _items '}'
anonymous_function: 'function' parameters=formal_parameters ['use' formal_parameters] body=_block
arrow_function: 'fn' parameters=formal_parameters '=>' body=_expr
array_element_initializer: _expr ['=>' _expr]
array_creation_expression: '[' [array_element_initializer {',' array_element_initializer} [',']] ']' | 'array' '(' [array_element_initializer {',' array_element_initializer} [',']] ')'
object_creation_expression: 'new' name [arguments=argument_list]
use_declaration: ('namespace' | 'use') {!END _any} END
global_declaration: 'global' variable_name {',' variable_name} END
_special: anonymous_function | arrow_function | array_creation_expression | object_creation_expression | variable_name
_statement: compound_statement | foreach_statement | _flow | echo_statement | use_declaration | global_declaration | class_declaration | function_definition | property_declaration | expression_statement
""",
    "go": _COMMON + """
source_file: _items
_exprs: expression_list
expression_list: _expr {',' _expr}
if_statement: 'if' [initializer=_simple ';'] condition=_bare consequence=block ['else' alternative=(if_statement | block)]
for_statement: 'for' [range_clause | for_clause | _bare] body=block
for_clause: [initializer=_simple] ';' [condition=_bare] ';' [update=_plain]
range_clause: [left=expression_list (':=' | '=')] 'range' right=_bare
switch_statement: 'switch' [initializer=_simple ';'] [_bare] body=switch_body
switch_label: 'case' _exprs ':' | 'default' ':'
short_var_declaration: left=expression_list ':=' right=expression_list
assignment_statement: left=expression_list _assign right=expression_list
inc_statement: _expr '++'
dec_statement: _expr '--'
_simple: short_var_declaration | _plain | _bare
_plain: assignment_statement | inc_statement | dec_statement
var_declaration: 'var' (var_spec | '(' {var_spec END} ')') END
const_declaration: 'const' (var_spec | '(' {var_spec END} ')') END
var_spec: name=id {',' id} [type=_type] ['=' value=expression_list]
type_declaration: 'type' type_id _type END
array_type: '[' [_expr] ']' _type
pointer_type: '*' _type
map_type: 'map' '[' _type ']' _type
channel_type: 'chan' _type
function_type: 'func' parameter_list [_type | parameter_list]
struct_type: 'struct' '{' {field_declaration} '}'
field_declaration: field_id {',' field_id} _type [string] END | _type END
interface_type: 'interface' '{' {!'}' _any} '}'
qualified_type: id '.' type_id
_type: array_type | pointer_type | map_type | channel_type | function_type | struct_type | interface_type | qualified_type | type_id
parameter_list: '(' [parameter_declaration {',' parameter_declaration}] ')'
parameter_declaration: name=id {',' name=id} ['...'] type=_type | ['...'] type=_type
function_declaration: 'func' [receiver=parameter_list] name=id parameters=parameter_list [result=(_type | parameter_list)] body=block
func_literal: 'func' parameters=parameter_list [result=(_type | parameter_list)] body=block
literal_value: '{' [_keyed {',' _keyed} [',']] '}'
_keyed: keyed_element | literal_value | _expr
keyed_element: _expr ':' (literal_value | _expr)
composite_literal: type=(array_type | map_type) body=literal_value
go_statement: ('go' | 'defer') _expr END
package_clause: 'package' id END
import_declaration: 'import' (string | '(' {string END} ')') END
simple_statement: _simple END
_special: func_literal | composite_literal
_statement: block | _flow | package_clause | import_declaration | type_declaration | var_declaration | const_declaration | function_declaration | go_statement | simple_statement
""",
    "ruby": """
program: _items
then: _items
do: 'do' _items 'end'
_then: ['then'] body=then
if: 'if' condition=_expr consequence=_then [alternative=(elsif | else)] 'end'
unless: 'unless' condition=_expr consequence=_then [else] 'end'
elsif: 'elsif' condition=_expr consequence=_then [alternative=(elsif | else)]
else: 'else' _items
while: 'while' condition=_expr body=_do
until: 'until' condition=_expr body=_do
_do: do | do_lines
do_lines: _items 'end'
for: 'for' pattern=_targets 'in' value=_expr body=_do
case: 'case' [value=_expr] {when} [else] 'end'
when: 'when' _expr {',' _expr} _then
begin: 'begin' _items {rescue} [else] [ensure] 'end'
rescue: 'rescue' [!END _expr {',' _expr} ['=>' id]] _then
ensure: 'ensure' _items
method: 'def' ['self' '.'] name=id [parameters=(method_parameters | bare_parameters)] _items {rescue} [ensure] 'end'
method_parameters: '(' [_parameter {',' _parameter}] ')'
bare_parameters: !END _parameter {',' _parameter}
_parameter: keyword_parameter | optional_parameter | splat_parameter | id
keyword_parameter: name=id ':' [value=_expr]
optional_parameter: name=id '=' value=_expr
splat_parameter: ('*' | '&' | '**') id
class: 'class' id ['<' _expr] _items 'end'
module: 'module' id _items 'end'
_targets: left_assignment_list | id
left_assignment_list: id ',' id {',' id}
right_assignment_list: _expr ',' _expr {',' _expr}
assignment: left=left_assignment_list '=' right=(right_assignment_list | _expr)
return: 'return' [!END !'if' !'unless' _expr {',' _expr}]
break: 'break'
next: 'next' [!END !'if' !'unless' _expr]
yield: 'yield' [!END (argument_list | _expr {',' _expr})]
argument_list: '(' [_argument {',' _argument}] ')'
_argument: pair | splat_argument | _expr
splat_argument: ('*' | '&' | '**') _expr
pair: (id | string) ':' _expr | _expr '=>' _expr
array: '[' [_argument {',' _argument} [',']] ']'
hash: '{' [pair {',' pair} [',']] '}'
symbol: ':' id
parenthesized_statements: '(' _items ')'
block: '{' [block_parameters] _items '}'
do_block: 'do' [block_parameters] _items 'end'
block_parameters: '|' id {',' id} '|'
lambda: '->' [method_parameters] (block | do_block)
_special: if | unless | while | until | for | case | begin | method | class | module | return | break | next | yield | lambda | symbol | array | hash
_simple: assignment | _expr
modified: _simple
_statement: _modified END
_modified: _simple
""",
}

#: Names of expressions by language; what is missing has the name itself.
KINDS = {
    "java": {"augmented": "assignment_expression", "call": "method_invocation", "member": "field_access", "index": "array_access", "field": "identifier", "unary": "unary_expression", "prefixed": "update_expression"},
    "c_sharp": {"augmented": "assignment_expression", "call": "invocation_expression", "member": "member_access_expression", "index": "element_access_expression", "field": "identifier", "unary": "prefix_unary_expression", "update": "postfix_unary_expression", "prefixed": "prefix_unary_expression"},
    "javascript": {"call": "call_expression", "member": "member_expression", "index": "subscript_expression", "field": "property_identifier"},
    "php": {"call": "function_call_expression", "member": "member_access_expression", "index": "subscript_expression", "field": "name", "unary": "unary_op_expression"},
    "go": {"call": "call_expression", "member": "selector_expression", "index": "index_expression", "field": "field_identifier"},
    "ruby": {"assignment": "assignment", "augmented": "operator_assignment", "call": "method_call", "member": "call", "index": "element_reference", "field": "identifier", "binary": "binary", "unary": "unary", "ternary": "conditional"},
}
_NAMES = {"assignment": "assignment_expression", "augmented": "augmented_assignment_expression", "binary": "binary_expression", "unary": "unary_expression", "update": "update_expression", "prefixed": "update_expression", "ternary": "ternary_expression"}
#: Binary signs, the loosest first.
_LEVELS = ["or and xor", "?? ||", "&&", "|", "^", "&", "== != === !== <=> =~ !~", "< > <= >= instanceof in is as", ".. ...", "<< >> >>>", "+ -", "* / %", "**"]
_SIGNS = {sign: level for level, signs in enumerate(_LEVELS, 2) for sign in signs.split()}
#: Signs that are words, and the languages that have them.
_WORDS = {"or": ("php", "ruby"), "and": ("php", "ruby"), "xor": ("php",), "not": ("ruby",), "instanceof": ("java", "javascript", "php"), "in": ("javascript",), "is": ("c_sharp",), "as": ("c_sharp",), "typeof": ("javascript", "c_sharp"), "await": ("javascript", "c_sharp"), "delete": ("javascript",), "void": ("javascript",)}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= .= &^=".split())
_PREFIX = frozenset("- + ! ~ & * typeof not await delete void <- @".split())
#: Where a line's end ends a statement, and ends an expression unless the next line begins with a dot.
_LINES = frozenset(("javascript", "go", "ruby"))
_HASH = frozenset(("php", "ruby"))
_CLOSERS = {"ruby": frozenset("end else elsif when rescue ensure } )".split())}
_DEFAULT_CLOSERS = frozenset("} case default".split())

_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\f\v]+)|(?P<line>\n)|(?P<note>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?)|(?P<number>\d(?:[\w]|\.(?=\d))*)|(?P<name>@{0,2}[^\W\d]\w*)|(?P<sign>>>>=|\.\.\.|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|<=>|=>|->|::|\?\.|&\.|:=|\+\+|--|<-|&\^=|[-+*/%&|^.<>=!]=|=~|!~|&&|\|\||\?\?|\*\*|\.\.|<<|>>|.)""",
    re.S,
)
_NOTE, _TAG = re.compile(r"#[^\n]*"), re.compile(r"<\?(?:php\b|=)?|\?>")


def tokens(source: str, language: str) -> list[tuple[str, str, bool]]:
    """(kind, text, whether a line begins) of each token: name, text, number or sign; comments are left out."""
    out, at, line = [], 0, True
    source = _TAG.sub(" ", source) if language == "php" else source
    while at < len(source):
        if source[at] == "#" and language in _HASH:
            at = _NOTE.match(source, at).end()
            continue
        m = _TOKEN.match(source, at)
        kind, text, at = m.lastgroup, m[0], m.end()
        if kind == "name" and language == "ruby" and source[at : at + 1] in ("?", "!") and source[at + 1 : at + 2] not in ("=", ":"):
            text, at = text + source[at], at + 1
        if kind == "line" or kind == "note" and "\n" in text:
            line = True
        elif kind not in ("skip", "note"):
            out.append((kind, text, line))
            line = False
    return out


_PART = re.compile(r"\s*('(?:\\.|[^'])*'|\w+=|\w+|[][{}()|!&])")


def _compiled(right: str):
    """A rule's right side as nested tuples."""
    parts = _PART.findall(right)
    at = 0

    def choice(stop):
        nonlocal at
        options, row = [], []
        while at < len(parts) and parts[at] != stop:
            if parts[at] == "|":
                options.append(("seq", row))
                row, at = [], at + 1
            else:
                row.append(item())
        at += 1
        options.append(("seq", row))
        return options[0] if len(options) == 1 else ("any", options)

    def item():
        nonlocal at
        x, at = parts[at], at + 1
        if x in "[{(":
            inner = choice({"[": "]", "{": "}", "(": ")"}[x])
            return inner if x == "(" else ("maybe" if x == "[" else "many", inner)
        if x in "!&":
            return ("not" if x == "!" else "ahead", item())
        if x[0] == "'":
            return ("word", x[1:-1].replace("\\\\", "\\"))
        return ("field", x[:-1], item()) if x[-1] == "=" else ("rule", x)

    return choice(None)


@lru_cache(maxsize=None)
def _grammar(language: str) -> tuple[dict, str, frozenset]:
    """Rules, the first of them, and the words that are no names."""
    lines = [x.split(":", 1) for x in GRAMMARS[language].split("\n") if x]
    rules = {k.strip(): _compiled(v) for k, v in lines}
    start = next(k for k in ("program", "compilation_unit", "source_file") if k in rules)
    words = frozenset(w for w in re.findall(r"'(\w+)'", GRAMMARS[language])) - frozenset(("of", "self", "async", "object", "string", "package", "type", "map", "array"))
    return rules, start, words | {w for w, own in _WORDS.items() if language in own}


#: Rules that may begin with any word.
_OPEN = frozenset("id type_id field_id property_id name number string _expr _bare _unary _items END _any _assign".split())


@lru_cache(maxsize=None)
def _first(language: str) -> dict[str, frozenset | None]:
    """The words and signs that a rule can begin with; None if that is open or it may be empty."""
    rules = _grammar(language)[0]
    known: dict[str, tuple[frozenset | None, bool]] = {}

    def of(rule) -> tuple[frozenset | None, bool]:
        """What a part begins with, and whether it may be empty."""
        what = rule[0]
        if what == "word":
            return frozenset((rule[1],)), False
        if what == "rule":
            if rule[1] in _OPEN:
                return None, rule[1] in ("_items", "END")
            if rule[1] not in known:
                known[rule[1]] = None, False  # for a rule within itself
                known[rule[1]] = of(rules[rule[1]])
            return known[rule[1]]
        if what in ("maybe", "many"):
            return of(rule[1])[0], True
        if what in ("not", "ahead"):
            return frozenset(), True
        if what == "field":
            return of(rule[2])
        found: frozenset | None = frozenset()
        empty = what == "seq"
        for part in rule[1]:
            own, may = of(part)
            found = None if found is None or own is None else found | own
            if what == "seq" and not may:
                return found, False
            empty = empty or may and what == "any"
        return found, empty

    out = {}
    for name in rules:
        found, empty = of(("rule", name))
        out[name] = None if empty else found
    return out


_LEAF = {"id": "identifier", "type_id": "type_identifier", "field_id": "field_identifier", "property_id": "property_identifier", "name": "name"}


class Reader:
    """Reads one source by its language's table."""

    def __init__(self, source: str, language: str):
        self.tokens, self.language = tokens(source, language), language
        self.rules, self.start, self.words = _grammar(language)
        self.memo: dict = {}
        self.kinds = _NAMES | KINDS[language]
        self.closers = _CLOSERS.get(language, _DEFAULT_CLOSERS)
        self.lines = language in _LINES
        self.first = _first(language)

    def text(self, at: int) -> str:
        return self.tokens[at][1] if at < len(self.tokens) else ""

    def tree(self) -> Node:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 20_000))
        try:
            children, at = [], 0
            while at < len(self.tokens):
                own, at = self.items(at)
                children += own
                if at < len(self.tokens):  # something closes that nothing opened
                    children.append((None, Node("ERROR", (self.leaf(at),))))
                    at += 1
        except RecursionError:  # nested beyond any program: one flat node
            children = [(None, Node("ERROR", tuple(self.leaf(i) for i in range(len(self.tokens)))))]
        finally:
            sys.setrecursionlimit(limit)
        return self.node(self.start, children)

    def leaf(self, at: int, kind: str | None = None) -> Node:
        what, text, _ = self.tokens[at]
        if kind is None:
            kind = {"text": "string", "number": "number"}.get(what) or ("identifier" if what == "name" and text not in self.words else text)
        return Node(kind, text=text, place=at)

    @staticmethod
    def node(kind: str, found: list) -> Node:
        fields: dict = {}
        for name, child in found:
            if name:
                fields.setdefault(name, child)
        return Node(kind, tuple(c for _, c in found), fields)

    # Rules: each gives (children with their field, next place), or None.

    def run(self, rule, at: int):
        what = rule[0]
        if what == "seq":
            out = []
            for part in rule[1]:
                got = self.run(part, at)
                if got is None:
                    return None
                out += got[0]
                at = got[1]
            return out, at
        if what == "rule":
            return self.named(rule[1], at)
        if what == "word":
            if at >= len(self.tokens) and rule[1] in ("}", "end"):
                return [], at  # what is open when the text ends is closed there
            return ([(None, self.leaf(at, rule[1]))], at + 1) if self.text(at) == rule[1] and self.tokens[at][0] in ("name", "sign") else None
        if what == "any":
            return next((got for x in rule[1] if (got := self.run(x, at)) is not None), None)
        if what == "field":
            got = self.run(rule[2], at)
            return got and ([(rule[1], c) for _, c in got[0]], got[1])
        if what == "maybe":
            return self.run(rule[1], at) or ([], at)
        if what == "many":
            out = []
            while (got := self.run(rule[1], at)) is not None and got[1] > at:
                out += got[0]
                at = got[1]
            return out, at
        if (self.run(rule[1], at) is not None) == (what == "ahead"):
            return [], at
        return None

    def named(self, name: str, at: int):
        if name == "_items":
            return self.items(at)
        if name == "END":
            return self.end(at)
        if name in _LEAF:
            return ([(None, self.leaf(at, _LEAF[name]))], at + 1) if at < len(self.tokens) and self.tokens[at][0] == "name" and (self.text(at) not in self.words or name == "property_id") else None
        if name in ("number", "string"):
            return ([(None, self.leaf(at))], at + 1) if at < len(self.tokens) and self.tokens[at][0] == {"number": "number", "string": "text"}[name] else None
        if name == "_any":
            return ([(None, self.leaf(at))], at + 1) if at < len(self.tokens) else None
        if name == "_assign":
            return ([(None, self.leaf(at, self.text(at)))], at + 1) if self.text(at) in _ASSIGN else None
        first = self.first.get(name)
        if first is not None and self.text(at) not in first:
            return None
        key = (name, at)
        if key not in self.memo:
            self.memo[key] = None  # a rule that begins with itself does not fit
            if name in ("_expr", "_bare", "_unary"):
                got = self.expression(at, 0 if name != "_unary" else 15, name == "_bare")
                self.memo[key] = got and ([(None, got[0])], got[1])
            else:
                got = self.run(self.rules[name], at)
                self.memo[key] = got if got is None or name[0] == "_" else ([(None, self.node(name, got[0]))], got[1])
        return self.memo[key]

    def end(self, at: int):
        if self.text(at) == ";":
            return [(None, self.leaf(at, ";"))], at + 1
        if at >= len(self.tokens) or self.text(at) in ("}", ")") or self.lines and (self.tokens[at][2] or self.text(at) in self.closers):
            return [], at
        return None

    def items(self, at: int):
        """Statements up to what closes them; what is none goes into ERROR nodes."""
        out = []
        while at < len(self.tokens) and self.text(at) not in self.closers:
            if self.text(at) == ";":
                out.append((None, self.leaf(at, ";")))
                at += 1
                continue
            got = self.named("_statement", at)
            if got is None or got[1] == at:
                stop = self.skipped(at)
                got = [(None, Node("ERROR", tuple(self.leaf(i) for i in range(at, stop))))], stop
            out += got[0]
            at = got[1]
        return out, at

    def skipped(self, at: int) -> int:
        """The end of what cannot be read: past a semicolon or the line, before a brace or a closer."""
        first = at
        while at < len(self.tokens):
            if at > first and (self.tokens[at][2] or self.text(at) == "{" or self.text(at) in self.closers):
                return at
            at += 1
            if self.text(at - 1) == ";":
                return at
        return at

    # Expressions.

    def made(self, name: str, *parts) -> Node:
        return self.node(self.kinds.get(name, name), list(parts))

    def expression(self, at: int, least: int, bare: bool = False):
        """An expression of signs that bind at least so tightly, and the next place; ``bare``: no braces belong to it."""
        got = self.operand(at, bare)
        if got is None:
            return None
        left, at = got
        while at < len(self.tokens):
            kind, sign, line = self.tokens[at]
            if line and (self.language in ("go", "ruby") and sign not in (".", "&.") or self.lines and sign in ("(", "[", "++", "--")):
                break
            if sign in _ASSIGN and self.language != "go" and least <= 1:
                right = self.expression(at + 1, 1, bare)
                if right is None:
                    break
                if self.language == "ruby" and sign == "=" and self.text(right[1]) == "," and (more := self.named("right_assignment_list", at + 1)):
                    right = more[0][0][1], more[1]
                left, at = self.made("assignment" if sign == "=" else "augmented", ("left", left), (None, self.leaf(at, sign)), ("right", right[0])), right[1]
            elif sign == "?" and least <= 1 and (yes := self.expression(at + 1, 1)) and self.text(yes[1]) == ":" and (no := self.expression(yes[1] + 1, 1)):
                left, at = self.made("ternary", ("condition", left), (None, self.leaf(at, "?")), ("consequence", yes[0]), (None, self.leaf(yes[1], ":")), ("alternative", no[0])), no[1]
            elif sign in ("if", "unless", "while", "until", "rescue") and self.language == "ruby" and not line and least == 0 and (test := self.expression(at + 1, 1)):
                left, at = self.made(f"{sign}_modifier", ("body", left), (None, self.leaf(at, sign)), ("condition", test[0])), test[1]
            elif sign == "." and self.language == "php" or sign in _SIGNS and (kind == "sign" or self.language in _WORDS[sign]):
                level = 10 if sign == "." else _SIGNS[sign]
                if level < least or level < 2:
                    break
                right = self.expression(at + 1, level if sign == "**" else level + 1, bare)
                if right is None:
                    break
                left, at = self.made("binary", ("left", left), (None, self.leaf(at, sign)), ("right", right[0])), right[1]
            else:
                break
        return left, at

    def operand(self, at: int, bare: bool):
        kind, sign, _ = self.tokens[at] if at < len(self.tokens) else ("", "", False)
        if sign in ("++", "--") and (got := self.operand(at + 1, bare)):
            return self.made("prefixed", (None, self.leaf(at, sign)), (None, got[0])), got[1]
        special = self.named("_special", at)
        if special:
            return self.postfixed(special[0][0][1], special[1], bare)
        if sign in _PREFIX and (kind == "sign" or self.language in _WORDS[sign]) and (got := self.operand(at + 1, bare)):
            return self.made("unary", (None, self.leaf(at, sign)), ("operand", got[0])), got[1]
        if kind in ("number", "text") or kind == "name" and sign not in self.words:
            own = self.leaf(at, "name" if self.language == "php" and kind == "name" else None)
            return self.postfixed(own, at + 1, bare)
        inner = self.named("parenthesized_statements" if self.language == "ruby" else "parenthesized_expression", at) if sign == "(" else None
        return inner and self.postfixed(inner[0][0][1], inner[1], bare)

    def postfixed(self, left: Node, at: int, bare: bool):
        while at < len(self.tokens):
            kind, sign, line = self.tokens[at]
            if line and self.lines and sign not in (".", "?.", "&."):
                break
            if sign == "(" and (args := self.named("argument_list", at)):
                left, at = self.made("call", ("function", left), ("arguments", args[0][0][1])), args[1]
            elif sign == "[" and (got := self.run(_INDEX, at)):
                left, at = self.made("index", ("object", left), *got[0]), got[1]
            elif sign in (".", "?.", "&.", "->", "::") and not (sign == "." and self.language == "php") and at + 1 < len(self.tokens) and self.tokens[at + 1][0] == "name":
                left, at = self.made("member", ("object", left), (None, self.leaf(at, sign)), ("field", self.leaf(at + 1, self.kinds["field"]))), at + 2
            elif sign in ("->", "::") and self.language == "php" and (got := self.named("variable_name", at + 1)):
                left, at = self.made("member", ("object", left), (None, self.leaf(at, sign)), *got[0]), got[1]
            elif sign in ("++", "--") and self.language not in ("go", "ruby"):
                left, at = self.made("update", ("argument", left), (None, self.leaf(at, sign))), at + 1
            elif self.language == "ruby" and sign in ("{", "do") and left.kind in ("method_call", "call", "identifier") and not bare and not (sign == "do" and self.headed(at)) and (got := self.named("block" if sign == "{" else "do_block", at)):
                left, at = self.made("call", ("method", left), ("block", got[0][0][1])), got[1]
            elif self.language == "ruby" and not line and left.kind in ("identifier", "call") and (kind in ("text", "number") or kind == "name" and sign not in self.words) and (got := self.run(_COMMAND, at)):
                left, at = self.made("call", ("method", left), ("arguments", self.node("argument_list", got[0]))), got[1]
            elif self.language == "go" and sign == "{" and not bare and left.kind in ("identifier", "selector_expression") and (got := self.named("literal_value", at)):
                left, at = self.node("composite_literal", [("type", left), ("body", got[0][0][1])]), got[1]
            else:
                break
        return left, at

    def headed(self, at: int) -> bool:
        """Whether a do belongs to the loop whose head stands on its line."""
        while at > 0 and not self.tokens[at][2]:
            at -= 1
            if self.text(at) in ("while", "until", "for"):
                return True
        return False


_INDEX, _COMMAND = _compiled("'[' [_exprs_or_slice] ']'"), _compiled("_argument {',' _argument}")
for _name, _text in GRAMMARS.items():
    GRAMMARS[_name] = _text + ("_exprs_or_slice: [_expr] ':' [_expr] | _expr\n" if _name == "go" else "_exprs_or_slice: _expr {',' _expr}\n")


def parsed(source: str, language: str) -> Node:
    """The tree of a source."""
    return Reader(source, language).tree()


def shown(node: Node) -> str:
    """The named nodes as an S-expression, with the names of fields."""
    if node.text is not None:
        return f"({node.kind})"
    names = {id(c): f"{k}: " for k, c in node.fields.items()}
    return f"({' '.join([node.kind, *(names.get(id(c), '') + shown(c) for c in node.children if c.named)])})"


def subtrees(tree: Node) -> list[str]:
    """A digest of the S-expression of every inner node; equal ones have equal shapes."""
    out: list[str] = []
    done: dict[int, str] = {}
    stack = [(tree, False)]
    while stack:
        node, ready = stack.pop()
        if node.text is not None:
            done[id(node)] = node.kind
        elif not ready:
            stack.append((node, True))
            stack.extend((c, False) for c in node.children)
        else:
            names = {id(c): k for k, c in node.fields.items()}
            parts = [node.kind, *(f"{names.get(id(c), '')}:{done[id(c)]}" for c in node.children if c.named)]
            done[id(node)] = hashlib.blake2b(" ".join(parts).encode(), digest_size=8).hexdigest()
            if node.children or node is tree:
                out.append(done[id(node)])
    return out
