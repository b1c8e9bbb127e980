"""Expressions of the rules in two SQL dialects: Spark's, which runs them, and DuckDB's, which checks them.

Rules are written once against `Dialect`; the engines' regular expressions, array functions and literals differ, so
each method knows both. Patterns follow Python's `re`: Unicode classes and case, `.` and `$` that know only line feeds.
"""

from __future__ import annotations

from functools import reduce


class Dialect:
    """What both dialects share."""

    def coalesce(self, *xs: str) -> str:
        return f"coalesce({', '.join(xs)})"

    def first(self, text: str, patterns: list[str], flags: str = "i", group: int = 1) -> str:
        """The first pattern that matches wins; null if none does."""
        return self.coalesce(*[self.extract(text, p, flags, group) for p in patterns], "NULL") if len(patterns) > 1 else self.extract(text, patterns[0], flags, group)

    def any(self, text: str, patterns: list[str], flags: str = "i") -> str:
        return "(" + " OR ".join(self.has(text, p, flags) for p in patterns) + ")"

    def ladder(self, *cases: tuple[str, str], other: str = "NULL") -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {other} END"

    def isin(self, x: str, values) -> str:
        return f"{x} IN ({', '.join(self.text(v) for v in values)})"

    def capital(self, x: str) -> str:
        return f"concat(upper(left({x}, 1)), lower(substr({x}, 2)))"

    def clean(self, x: str) -> str:
        """White space off both ends, then full stops and commas off the end."""
        return self.rstrip(self.strip(x))

    def sentences(self, x: str, n: int = 3) -> str:
        """The first n sentences, with one blank between them."""
        return self.strip(self.join(self.head(self.pieces(x), n), " "))

    def cut(self, x: str, most: int = 500) -> str:
        """Long text ends at its last blank within `most` characters, with an ellipsis."""
        return f"CASE WHEN length({x}) > {most} THEN concat({self.last_word_off(f'left({x}, {most})')}, '...') ELSE {x} END"

    def made_id(self, *parts: str) -> str:
        """An identifier made of texts, the same for the same texts, in the usual five groups."""
        h = self.digest(f"concat_ws(chr(31), {', '.join(parts)})")
        return f"concat_ws('-', {', '.join(f'substr({h}, {a}, {n})' for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))})"

    def compact(self, *cases: tuple[str, str]) -> str:
        """An array of the texts whose condition holds."""
        return self.nonnull([f"CASE WHEN {c} THEN {v} END" for c, v in cases])


class Spark(Dialect):
    name = "spark"

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def _re(self, pattern: str, flags: str) -> str:
        on = "Ud" + ("iu" if "i" in flags else "") + ("m" if "m" in flags else "") + ("s" if "s" in flags else "")
        return self.text(f"(?{on}){pattern}".replace("\\Z", "\\z"))

    def extract(self, x: str, pattern: str, flags: str = "i", group: int = 1) -> str:
        return f"nullif(regexp_extract({x}, {self._re(pattern, flags)}, {group}), '')"

    def has(self, x: str, pattern: str, flags: str = "i") -> str:
        return f"({x} RLIKE {self._re(pattern, flags)})"

    def all(self, x: str, pattern: str, flags: str = "i", group: int = 1) -> str:
        return f"regexp_extract_all({x}, {self._re(pattern, flags)}, {group})"

    def replace(self, x: str, pattern: str, new: str, flags: str = "") -> str:
        return f"regexp_replace({x}, {self._re(pattern, flags)}, {new})"

    def strip(self, x: str) -> str:
        return self.replace(x, r"^\s+|\s+\Z", "''")

    def rstrip(self, x: str, marks: str = ".,") -> str:
        return f"rtrim({self.text(marks)}, {x})"

    def pieces(self, x: str) -> str:
        return f"split({self.replace(x, '([.!?])' + chr(92) + 's+', 'concat(' + self.text('$1') + ', chr(1))')}, chr(1))"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self._re(pattern, '')})"

    def join(self, xs: str, by: str) -> str:
        return f"array_join({xs}, {self.text(by)})"

    def head(self, xs: str, n: int) -> str:
        return f"slice({xs}, 1, {n})"

    def at(self, xs: str, i: int) -> str:
        return f"try_element_at({xs}, {i})"

    def size(self, xs: str) -> str:
        return f"size({xs})"

    def each(self, xs: str, f) -> str:
        return f"transform({xs}, x -> {f('x')})"

    def only(self, xs: str, f) -> str:
        return f"filter({xs}, x -> {f('x')})"

    def sorted(self, xs: str) -> str:
        return f"array_sort(array_distinct({xs}))"

    def plus(self, *xs: str) -> str:
        return f"concat({', '.join(xs)})"

    def nonnull(self, xs: list[str]) -> str:
        return f"array_compact(array({', '.join(xs)}))"

    def empty(self) -> str:
        return "cast(array() as array<string>)"

    def last_word_off(self, x: str) -> str:
        return self.replace(x, r" [^ ]*\Z", "''", "s")

    def number(self, x: str, kind: str) -> str:
        return f"try_cast({x} AS {kind})"

    def digest(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def fixed(self, x: str, digits: int = 2) -> str:
        # Not format_string, which rounds the shortest decimal of a number half up, not its exact value.
        return f"format_number({x}, '{'0.' + '0' * digits if digits else '0'}')"

    def parsed(self, j: str) -> str:
        """A JSON text as a value, parsed once; null if it isn't JSON. `part`, `type_of`, `said` and `items` look into it."""
        return f"try_parse_json({j})"

    def part(self, v: str, key: str) -> str:
        return f"variant_get({v}, '$.{key}')"

    def type_of(self, v: str, key: str) -> str:
        """The engine's own name for a member's type, which `kind_of` explains; null where the key is missing."""
        return f"schema_of_variant(variant_get({v}, '$.{key}'))"

    def whole_type(self, v: str) -> str:
        """The engine's own name for a value's type; null of null."""
        return f"schema_of_variant({v})"

    def members(self, v: str, key: str) -> str:
        """The number of a list's members; null if the member isn't a list."""
        return f"array_size(try_variant_get({v}, '$.{key}', 'array<variant>'))"

    def keys(self, v: str, key: str) -> str:
        """An object's keys; null if the member isn't there."""
        return f"map_keys(try_variant_get({v}, '$.{key}', 'map<string,string>'))"

    def pairs(self, v: str, key: str) -> str:
        """An object's members as texts 'key: value', sorted; null if the member isn't there."""
        return f"array_sort(transform(map_entries(try_variant_get({v}, '$.{key}', 'map<string,string>')), x -> concat(x.key, ': ', coalesce(x.value, 'None'))))"

    def kind_of(self, t: str) -> str:
        """string, null, object, array, boolean, number of a type name; null of null."""
        return self.ladder((f"{t} = 'STRING'", "'string'"), (f"{t} = 'VOID'", "'null'"), (f"{t} LIKE 'OBJECT%'", "'object'"), (f"{t} LIKE 'ARRAY%'", "'array'"), (f"{t} = 'BOOLEAN'", "'boolean'"), (f"{t} IS NOT NULL", "'number'"))

    def said(self, v: str, key: str) -> str:
        """A member as text."""
        return f"try_variant_get({v}, '$.{key}', 'string')"

    def items(self, v: str, key: str) -> str:
        """A list of texts; null if the member isn't a list, with nulls for members that aren't texts."""
        return f"transform(try_variant_get({v}, '$.{key}', 'array<variant>'), x -> CASE WHEN schema_of_variant(x) = 'STRING' THEN cast(x AS string) END)"

    def json_has(self, j: str, key: str) -> str:
        return f"coalesce(array_contains(json_object_keys({j}), '{key}'), false)"

    def json_kind(self, j: str, key: str) -> str:
        """string, null, object, array, boolean, number; null where the key is missing."""
        kind = f"schema_of_variant(variant_get(try_parse_json({j}), '$.{key}'))"
        return self.ladder((f"{kind} = 'STRING'", "'string'"), (f"{kind} = 'VOID'", "'null'"), (f"{kind} LIKE 'OBJECT%'", "'object'"), (f"{kind} LIKE 'ARRAY%'", "'array'"), (f"{kind} = 'BOOLEAN'", "'boolean'"), (f"{kind} IS NOT NULL", "'number'"))

    def json_text(self, j: str, key: str) -> str:
        return f"get_json_object({j}, '$.{key}')"

    json_part = json_text

    def json_object(self, names) -> str:
        """A JSON text of columns, nulls kept."""
        return f"to_json(named_struct({', '.join(f"'{n}', {n}" for n in names)}), map('ignoreNullFields', 'false'))"

    def variant_text(self, j: str, path: str) -> str:
        return f"try_variant_get(try_parse_json({j}), '$.{path}', 'string')"

    def octets(self, x: str) -> str:
        return f"octet_length({x})"

    def json_size(self, j: str, key: str) -> str:
        return f"json_array_length(get_json_object({j}, '$.{key}'))"

    def count_if(self, x: str) -> str:
        return f"count_if({x})"

    def collect(self, x: str, order: str, where: str = "true") -> str:
        return f"transform(array_sort(collect_list(CASE WHEN {where} THEN struct({order} AS o, {x} AS v) END)), p -> p.v)"

    def distinct(self, x: str, where: str = "true") -> str:
        return f"collect_set(CASE WHEN {where} THEN {x} END)"

    def median(self, x: str) -> str:
        return f"percentile({x}, 0.5)"

    def place(self, xs: str, x: str) -> str:
        """Where a list has a value first, from 1."""
        return f"array_position({xs}, {x})"

    def together(self, *xs: str) -> str:
        """Values that are compared one after another."""
        return f"struct({', '.join(xs)})"


class Duck(Dialect):
    name = "duck"

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def _re(self, pattern: str, flags: str) -> str:
        on = "".join(f for f in "ims" if f in flags)
        return self.text((f"(?{on})" if on else "") + pattern.replace("\\Z", "\\z"))

    def extract(self, x: str, pattern: str, flags: str = "i", group: int = 1) -> str:
        return f"nullif(regexp_extract({x}, {self._re(pattern, flags)}, {group}), '')"

    def has(self, x: str, pattern: str, flags: str = "i") -> str:
        return f"regexp_matches({x}, {self._re(pattern, flags)})"

    def all(self, x: str, pattern: str, flags: str = "i", group: int = 1) -> str:
        return f"regexp_extract_all({x}, {self._re(pattern, flags)}, {group})"

    def replace(self, x: str, pattern: str, new: str, flags: str = "") -> str:
        return f"regexp_replace({x}, {self._re(pattern, flags)}, {new}, 'g')"

    def strip(self, x: str) -> str:
        return self.replace(x, r"^\s+|\s+\Z", "''")

    def rstrip(self, x: str, marks: str = ".,") -> str:
        return f"rtrim({x}, {self.text(marks)})"

    def pieces(self, x: str) -> str:
        return f"string_split({self.replace(x, '([.!?])' + chr(92) + 's+', 'concat(' + self.text(chr(92) + '1') + ', chr(1))')}, chr(1))"

    def split(self, x: str, pattern: str) -> str:
        return f"string_split_regex({x}, {self._re(pattern, '')})"

    def join(self, xs: str, by: str) -> str:
        return f"coalesce(array_to_string({xs}, {self.text(by)}), CASE WHEN {xs} IS NOT NULL THEN '' END)"

    def head(self, xs: str, n: int) -> str:
        return f"list_slice({xs}, 1, {n})"

    def at(self, xs: str, i: int) -> str:
        return f"list_extract({xs}, {i})"

    def size(self, xs: str) -> str:
        return f"len({xs})"

    def each(self, xs: str, f) -> str:
        return f"list_transform({xs}, lambda x: {f('x')})"

    def only(self, xs: str, f) -> str:
        return f"list_filter({xs}, lambda x: {f('x')})"

    def sorted(self, xs: str) -> str:
        return f"list_sort(list_distinct({xs}))"

    def plus(self, *xs: str) -> str:
        return reduce(lambda a, b: f"list_concat({a}, {b})", xs)

    def nonnull(self, xs: list[str]) -> str:
        return f"list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL)"

    def empty(self) -> str:
        return "cast([] as varchar[])"

    def last_word_off(self, x: str) -> str:
        return self.replace(x, r" [^ ]*\Z", "''", "s")

    def number(self, x: str, kind: str) -> str:
        return f"try_cast({x} AS {kind})"

    def digest(self, x: str) -> str:
        return f"sha256({x})"

    def fixed(self, x: str, digits: int = 2) -> str:
        return f"printf('%.{digits}f', {x})"

    def parsed(self, j: str) -> str:
        return f"CASE WHEN json_valid({j}) THEN CAST({j} AS JSON) END"

    def part(self, v: str, key: str) -> str:
        return f"json_extract({v}, '$.{key}')"

    def type_of(self, v: str, key: str) -> str:
        return f"json_type({v}, '$.{key}')"

    def whole_type(self, v: str) -> str:
        return f"json_type({v})"

    def members(self, v: str, key: str) -> str:
        return f"CASE WHEN json_type({v}, '$.{key}') = 'ARRAY' THEN json_array_length({v}, '$.{key}') END"

    def keys(self, v: str, key: str) -> str:
        return f"json_keys({v}, '$.{key}')"

    def pairs(self, v: str, key: str) -> str:
        return f"list_sort(list_transform(json_keys({v}, '$.{key}'), lambda x: concat(x, ': ', coalesce(json_extract_string({v}, '$.{key}.' || chr(34) || x || chr(34)), 'None'))))"

    def kind_of(self, t: str) -> str:
        return self.ladder((f"{t} = 'VARCHAR'", "'string'"), (f"{t} = 'NULL'", "'null'"), (f"{t} = 'OBJECT'", "'object'"), (f"{t} = 'ARRAY'", "'array'"), (f"{t} = 'BOOLEAN'", "'boolean'"), (f"{t} IS NOT NULL", "'number'"))

    def said(self, v: str, key: str) -> str:
        return f"json_extract_string({v}, '$.{key}')"

    def items(self, v: str, key: str) -> str:
        return f"CASE WHEN json_type({v}, '$.{key}') = 'ARRAY' THEN list_transform(CAST(json_extract({v}, '$.{key}') AS JSON[]), lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') END) END"

    def json_has(self, j: str, key: str) -> str:
        return f"coalesce(json_exists({j}, '$.{key}'), false)"

    def json_kind(self, j: str, key: str) -> str:
        kind = f"json_type({j}, '$.{key}')"
        return self.ladder((f"{kind} = 'VARCHAR'", "'string'"), (f"{kind} = 'NULL'", "'null'"), (f"{kind} = 'OBJECT'", "'object'"), (f"{kind} = 'ARRAY'", "'array'"), (f"{kind} = 'BOOLEAN'", "'boolean'"), (f"{kind} IS NOT NULL", "'number'"))

    def json_text(self, j: str, key: str) -> str:
        return f"json_extract_string({j}, '$.{key}')"

    def json_part(self, j: str, key: str) -> str:
        return f"json_extract({j}, '$.{key}')"

    def json_object(self, names) -> str:
        return f"CAST(json_object({', '.join(f"'{n}', {n}" for n in names)}) AS VARCHAR)"

    def variant_text(self, j: str, path: str) -> str:
        return f"json_extract_string({j}, '$.{path}')"

    def octets(self, x: str) -> str:
        return f"strlen({x})"

    def json_size(self, j: str, key: str) -> str:
        return f"json_array_length({j}, '$.{key}')"

    def count_if(self, x: str) -> str:
        return f"count(*) FILTER (WHERE {x})"

    def collect(self, x: str, order: str, where: str = "true") -> str:
        return f"coalesce(list({x} ORDER BY {order}) FILTER (WHERE {where}), [])"

    def distinct(self, x: str, where: str = "true") -> str:
        return f"coalesce(list(DISTINCT {x}) FILTER (WHERE ({where}) AND {x} IS NOT NULL), [])"

    def median(self, x: str) -> str:
        return f"median({x})"

    def place(self, xs: str, x: str) -> str:
        return f"list_position({xs}, {x})"

    def together(self, *xs: str) -> str:
        return f"row({', '.join(xs)})"
