"""The text rules as SQL functions, for SQL users: ``register(spark)``.

``clean_query(q)``, ``normalize_query(q, sites)``, ``extract_followers(text)``
and ``parse_human_number(number, unit)`` are temporary functions whose bodies
are SQL, so Catalyst inlines them. The bodies state the rules of
``functions.text`` and ``functions.followers`` and share their fixed values.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from serpframe.functions import followers as FO
from serpframe.functions import text as T


def _cleaned(x: str) -> str:
    return f"trim(regexp_replace({x}, r'(?U){T.WS}+', ' '))"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, r'(?U)^{T.WS}+|{T.WS}+$', '')"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _raw(text: str) -> str:
    """A raw string literal; the patterns hold no quotes."""
    return f"r'{text}'"


def _operators(q: str) -> str:
    s = _cleaned(f"coalesce({q}, '')")
    for pattern, kept in T.OPERATOR_RULES:
        s = f"regexp_replace({s}, {_raw('(?iU)' + pattern)}, '{kept}')"
    return s


def _blocks(s: str) -> str:
    return f"regexp_extract_all({s}, r'(?s).{{1,{T.BLOCK}}}', 0)"


def _drop_empty(s: str) -> str:
    step = "if(c = ')' and endswith(rtrim(acc), '('), left(rtrim(acc), length(rtrim(acc)) - 1), concat(acc, c))"
    opened, shut = "(length(e.o) - length(replace(e.o, '(')))", "(length(e.s) - length(replace(e.s, ')')))"
    n = f"least({opened}, {shut})"
    meet = _let(r"named_struct('o', regexp_extract(acc, r'[( ]*\z', 0), 's', regexp_extract(b, '^[) ]*', 0))", "e",
                f"if({n} = 0, concat(acc, b), concat(left(acc, length(acc) - length(e.o)), "
                f"substring_index(e.o, '(', {opened} - {n} + 1), substring_index(e.s, ')', {n} - {shut} - 1), "
                f"substring(b, length(e.s) + 1)))")
    return (f"aggregate(transform({_blocks(s)}, x -> aggregate(split(x, ''), '', (acc, c) -> {step})), '', "
            f"(acc, b) -> {meet})")


def _balanced(s: str) -> str:
    one = ("aggregate(split(x, ''), named_struct('o', 0, 'p', cast(array() as array<string>), 'd', ''), (acc, c) -> case "
           "when c = '(' then named_struct('o', acc.o + 1, 'p', acc.p, 'd', concat(acc.d, c)) "
           "when c = ')' and acc.o > 0 then named_struct('o', acc.o - 1, 'p', acc.p, 'd', concat(acc.d, c)) "
           "when c = ')' then named_struct('o', acc.o, 'p', concat(acc.p, array(acc.d)), 'd', '') "
           "else named_struct('o', acc.o, 'p', acc.p, 'd', concat(acc.d, c)) end, "
           "acc -> named_struct('o', acc.o, 'p', concat(acc.p, array(acc.d))))")
    k = "least(acc.o, size(b.p) - 1)"
    return (f"aggregate(transform({_blocks(s)}, x -> {one}), named_struct('o', 0, 'd', ''), (acc, b) -> named_struct("
            f"'o', acc.o - {k} + b.o, 'd', concat(acc.d, array_join(slice(b.p, 1, {k} + 1), ')'), "
            f"array_join(slice(b.p, {k} + 2, size(b.p)), ''))), acc -> concat(acc.d, repeat(')', acc.o)))")


def _scaled(number: str, unit: str) -> str:
    units = ", ".join(f"'{k}', {v}D" for k, v in FO.UNITS.items())
    return (f"(if({number} rlike {_raw(FO.NUMBER_TEXT)}, try_cast({number} as double), null) "
            f"* coalesce(try_element_at(map({units}), lower({unit})), 1D))")


def _followers(text: str) -> str:
    digits = r"regexp_extract(n, r'^[\d.]+', 0)"
    unit = r"regexp_extract(n, r'([kKmM])\+?$', 1)"
    number = _scaled(f"if({unit} = '', replace({digits}, '.'), {digits})", unit)

    def hit(p: str) -> str:
        count = _let(f"translate(regexp_extract({text}, {_raw(p)}, 1), ', ', '')", "n", f"try_cast({number} as bigint)")
        whole = _stripped(f"regexp_extract({text}, {_raw(p)}, 0)")
        return f"when {text} rlike {_raw(p)} then named_struct('followersText', {whole}, 'followersCount', {count})"
    return "case " + " ".join(hit(p) for p in FO.NORMALIZER_PATTERNS) + " end"


def _sites(q: str) -> str:
    valid = "filter(coalesce(sites, array()), s -> s is not null and startswith(s, 'site:'))"
    present = f"exists({valid}, s -> contains(lower({q}), substring(s, 6)))"
    return f"if(size({valid}) = 0 or {q} = '' or {present}, {q}, concat({q}, ' (', array_join({valid}, ' OR '), ')'))"


def bodies() -> dict[str, str]:
    """Signature and result of each function, and its body."""
    clean = _let(_operators("q"), "s", _cleaned(_balanced(_drop_empty("s"))))
    bare = r"regexp_replace(" + _stripped("number") + r", r'[ \x{00A0}\x{202F}]', '')"
    human = _let(bare, "s", _let("replace(s, ',', if(contains(s, '.'), '', '.'))", "p",
                                 f"try_cast(bround({_scaled('p', "coalesce(unit, '')")}, 0) as bigint)"))
    return {
        "clean_query(q string) returns string": clean,
        "normalize_query(q string, sites array<string>) returns string":
            _let("clean_query(q)", "c", _cleaned(f"lower({_sites('c')})")),
        "extract_followers(text string) returns struct<followersText: string, followersCount: bigint>":
            _followers("text"),
        "parse_human_number(number string, unit string) returns bigint": human,
    }


def register(spark: SparkSession) -> None:
    """Create (or replace) the temporary SQL functions in this session."""
    for head, body in bodies().items():
        spark.sql(f"create or replace temporary function {head} return {body}")
