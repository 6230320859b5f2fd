"""Text cleaning, tokens, sentences and rule-based extraction, as column expressions. Patterns are Java regular expressions."""

from __future__ import annotations

import re
import re._parser as _P
from functools import lru_cache, reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks of report texts and what they become, in order.
MARKS = [("§", " ENTER "), ('["-]', ""), (r"\*", " "), ("[/.,;]", " punkt ")]
ACCENTS, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"


def replace_all(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular-expression replacements in order."""
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def _bound(c: Column, f) -> Column:
    """f of c, which is computed once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _has(c: Column, texts: tuple[str, ...]) -> Column:
    """Whether any of the texts stands in c."""
    return reduce(lambda a, b: a | b, (c.contains(x) for x in texts))


def normalize_marks(c: Column) -> Column:
    return replace_all(c, MARKS)


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTS, PLAIN)


def tokenize(c: Column, stop_words: list[str], number: str = "#NUM") -> Column:
    """Lower-case tokens without stop words; a token that is not all letters becomes the number mark; accents are stripped."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: (w != "") & ~w.isin(stop_words))
    return F.transform(words, lambda w: F.when(w.rlike(r"^\p{L}+$"), strip_accents(w)).otherwise(F.lit(number)))


def terms(c: Column) -> Column:
    """Lower-case terms of two and more letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def drop_empty_segments(c: Column) -> Column:
    """Without the empty pieces between dots."""
    return F.array_join(F.filter(F.split(c, r"\."), lambda x: F.trim(x) != ""), ".")


# Names of columns and modules that conversion leaves in a fragment, and words that it glues to the word before.
HEADER_REMNANTS = ["execuçãoprocedimentosobjetivo", "execuçãoprocedimentoitem", "execuçãoprocedimento", "passocoordenaçãocontrolecomando", "chesf (cron)", "color:#ffffff", "<span>"]
GLUED = ["desenergização", "energização", "manobra", "lt"]

#: Words, with the signs that stand in them, and runs of other marks are set apart by a space.
_WORDLIKE = r"\p{L}\p{N}_/'+$\s-"
_BEFORE_MARK, _BEHIND_MARK = rf"(?<=[{_WORDLIKE}])(?=[^{_WORDLIKE}])", rf"(?<=[^{_WORDLIKE}])(?=[{_WORDLIKE}])"

#: In order: section numbers of three and four levels, or of two before a point or at the start; list markers; modules; bullets and dashes; headings with their number;
#: entities of the source format; codes of table columns; glued words and numbers; headers and bars of tables; runs of spaces.
FRAGMENT_RULES = [
    (r"[0-9]+(?:\.[0-9]+){2,3}\.?", ""),
    (r"^\s*[0-9]+\.[0-9]+\.?\s+|[0-9]+\.[0-9]+\.\s", ""),
    (r"(?:^|\s)(?:[a-eivx]{1,3}|[0-9]{1,2})\)\s+", ". "),
    (r"(?i)(?:sub)?m[óo]dulo(?:\s[0-9]+(?:\.[0-9]+)*\.?)?", ""),
    ("[•\uf0b7\uf044]", ""),
    (r"\s?[-–]\s", " "),
    (r"(?i)(?:objetivo|considerações gerais)[1-9]\.?", ""),
    ("&nbsp;|&#xa0;|\u00a0", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    (r"(?:-[0-9]|\b)[a-z]{3,4}-[a-z]{2,3}\b", ""),
    (r"(\p{Ll}{2})([0-9])", "$1 $2"),
    (r"(\p{Ll})(" + GLUED[0] + ")", "$1 $2"),
    (r"([\p{Ll}&&[^s]])(" + GLUED[1] + ")", "$1 $2"),
    (r"([0-9])((?:des)?energização)", "$1 $2"),
    (r"(\p{Ll})(" + GLUED[2] + ")", "$1 $2"),
    (r"(\p{Ll}{2})(" + GLUED[3] + r")(?=\s)", "$1 $2"),
    (r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})", " "),
    ("|".join(re.escape(x) for x in HEADER_REMNANTS), ""),
    (r"\s*\|\s*", " "),
    (r"\s+", " "),
]
#: The same with marks set apart before spaces are collapsed.
SPACED_RULES = [*FRAGMENT_RULES[:-1], (_BEFORE_MARK, " "), (_BEHIND_MARK, " "), FRAGMENT_RULES[-1]]


#: Texts one of which stands wherever the rule of this place in FRAGMENT_RULES changes something.
_ENTITY, _GLUE = ("&", "\u00a0"), (GLUED[1],)
_NEEDS = {FRAGMENT_RULES[i][0]: x for i, x in {2: (")",), 5: ("-", "–"), 7: _ENTITY, 8: _ENTITY, 9: _ENTITY, 10: _ENTITY, 11: ("-",), 13: _GLUE, 14: _GLUE, 15: _GLUE, 16: (GLUED[2],), 17: (GLUED[3],), 19: (HEADER_REMNANTS[2], *HEADER_REMNANTS[3:]), 20: ("|",)}.items()}
#: Forms of rules that change the same places alike and sooner, as at most places of a text their first and cheap test fails.
_SOONER = {
    FRAGMENT_RULES[3][0]: ("(?i)(?=[sm])" + FRAGMENT_RULES[3][0].removeprefix("(?i)"), ""),
    FRAGMENT_RULES[6][0]: ("(?i)(?=[oc])" + FRAGMENT_RULES[6][0].removeprefix("(?i)"), ""),
    FRAGMENT_RULES[18][0]: (r"(?=\p{Lu}\p{Ll})(?<=\p{Ll})", " "),
    FRAGMENT_RULES[21][0]: (r"\s{2,}|[\t\n\x0B\f\r]", " "),
    _BEFORE_MARK: (rf"(?=[^{_WORDLIKE}])(?<=[{_WORDLIKE}]{{1,2}})", " "),  # looking back counts two for a letter outside the first plane
    _BEHIND_MARK: (rf"([^{_WORDLIKE}])(?=[{_WORDLIKE}])", "$1 "),
}


def _cleaned(c: Column, rules: list[tuple[str, str]]) -> Column:
    """What replace_all makes of the rules above; a text is searched only for what its letters allow."""
    for needs, group in groupby(rules, lambda r: _NEEDS.get(r[0], ())):
        sooner = [_SOONER.get(r[0], r) for r in group]
        c = _bound(c, lambda x: F.when(_has(x, needs), replace_all(x, sooner)).otherwise(x)) if needs else replace_all(c, sooner)  # noqa: B023
    return c


def clean_fragment(c: Column, rules: list[tuple[str, str]] | None = None, apart: bool = True) -> Column:
    """A fragment without numbering, markers and remnants of tables, spaces collapsed, empty segments between dots dropped. With `apart` a space stands between
    words and marks, also within 13.8, as taggers of words expect."""
    return F.trim(drop_empty_segments(replace_all(c, rules) if rules else _cleaned(c, SPACED_RULES if apart else FRAGMENT_RULES)))


def clean_equipment(c: Column, tail: int = 14) -> Column:
    """Equipment name: the last tokens and empty ones dropped, the rest joined, letters inside numbers removed."""
    t = F.split(c, " ")
    kept = F.filter(F.slice(t, 1, F.greatest(F.size(t) - tail, F.lit(0))), lambda w: w != "")
    return F.regexp_replace(F.array_join(kept, " "), r"(?<=\d)\p{L}+(?=\d)", "")


def strip_tags(c: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags removed, the common entities resolved, spaces collapsed."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    return F.trim(replace_all(out, [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), (r"\s+", " ")]))


def check_rules(rules: list[str]) -> list[str]:
    """The rules; one that Python cannot compile, such as a bare operator, is an error here rather than in a task."""
    for r in rules:
        re.compile(r.replace(r"\p{L}", "x").replace(r"\p{Lu}", "X").replace(r"\p{Ll}", "x").replace(r"\p{N}", "0"))
    return rules


def literal(s: str) -> str:
    """A pattern for the text as it stands."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)


#: Signs that a rule takes for i, k and s, though lower case leaves them another sign: dotted and dotless i, the long s, the Kelvin sign.
_ODD = "\u0130\u0131\u017f\u212a"


def folded(c: Column) -> Column:
    """Lower-case text in which to look for what a case-insensitive rule needs; null, so that nothing is known, where one of four odd signs stands."""
    return F.when(~_has(c, _ODD), F.lower(c))


#: Letters that only they and their capitals are taken for in a text without the odd signs.
_SAFE = set("abcdefghijklmnopqrstuvwxyzáàâãéêíóôõúüç")


def _letter(op, arg) -> str:
    """The folded letter for which this item of a parsed rule stands, empty if it does not stand for one that folding tells."""
    letter = chr(arg).lower() if op is _P.LITERAL else ""
    return letter if letter in _SAFE or letter == letter.upper() else ""


def _head(tree) -> str:
    """The folded text with which every match of a parsed rule begins, as far as it is known."""
    out = ""
    for op, arg in tree:
        if not (letter := _letter(op, arg)):
            return out + (_head(arg[-1]) if op is _P.SUBPATTERN or op in (_P.MAX_REPEAT, _P.MIN_REPEAT) and arg[0] > 0 else "")
        out += letter
    return out


def _literals(tree) -> set[str] | None:
    """Folded texts one of which stands in every match of a parsed rule, None if none is known. Of several such sets that with the longest texts is taken."""
    found, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if letter := _letter(op, arg):
            run += letter
            continue
        found, run = found + [{run + _head([(op, arg)])}] * bool(run), ""
        if op is _P.SUBPATTERN or (op is _P.ASSERT and arg[0] == 1):
            found.append(_literals(arg[-1]))
        elif op in (_P.MAX_REPEAT, _P.MIN_REPEAT) and arg[0] > 0:
            found.append(_literals(arg[2]))
        elif op is _P.BRANCH:
            parts = [_literals(x) for x in arg[1]]
            found.append(None if None in parts else set().union(*parts))
    best = max(filter(None, found), key=lambda f: (min(map(len, f)), -len(f)), default=None)
    return best and {x for x in best if not any(y in x and y != x for y in best)}


def _firsts(tree) -> set[str] | None:
    """Letters one of which, in whatever case, begins every match of a parsed rule; None if they are not known or a match may be empty."""
    out: set[str] = set()
    for op, arg in tree:
        if op is _P.AT or op is _P.ASSERT_NOT or op is _P.ASSERT and arg[0] < 0:
            continue
        some = None
        if op is _P.LITERAL:
            some = {chr(arg)}
        elif op is _P.IN and all(o is _P.LITERAL for o, _ in arg):
            some = {chr(a) for _, a in arg}
        elif op in (_P.SUBPATTERN, _P.ASSERT, _P.MAX_REPEAT, _P.MIN_REPEAT):
            some = _firsts(arg[-1])
        elif op is _P.BRANCH:
            parts = [_firsts(x) for x in arg[1]]
            some = None if None in parts else set().union(*parts)
        if some is None:
            return None
        out |= some
        if not (op in (_P.MAX_REPEAT, _P.MIN_REPEAT) and arg[0] == 0):
            return out
    return None


def _parsed(rule: str):
    """The rule's items; none where its syntax is Java's alone."""
    return [] if any(x in rule for x in ("\\p", "&&")) else _P.parse(rule)


@lru_cache(None)
def needed(rule: str) -> tuple[str, ...]:
    """Folded texts one of which stands in each match of the rule; none where its syntax is Java's alone. A text without any of them need not be searched."""
    return tuple(sorted(_literals(_parsed(rule)) or ()))


@lru_cache(None)
def hinted(rule: str) -> str:
    """The rule behind a look at the letter with which a match begins, where such letters are known: most places of a text fail it at once, and are not tried for
    a word's edge and every alternative."""
    first = "".join(c if c.isalnum() else "\\" + c for c in sorted(_firsts(_parsed(rule)) or ()))
    return f"(?=[{first}])(?:{rule})" if first else rule


def _tidied(found: Column, strip: list[str] = (), drop: list[str] = ()) -> Column:
    """Distinct finds in order; `strip` patterns are removed from each, then empty ones and those in `drop` left out."""
    if strip:
        any_of = "(?iU)" + hinted("|".join(f"(?:{pattern})" for pattern in strip))  # most finds hold nothing to strip, which one search tells
        found = F.transform(found, lambda m: F.when(m.rlike(any_of), replace_all(m, [("(?iU)" + pattern, "") for pattern in strip])).otherwise(m))
    found = F.filter(found, lambda m: (m != "") & ~m.isin(list(drop)) if drop else m != "")
    return F.sort_array(F.array_distinct(found))


@lru_cache(None)
def _grouped(rules: tuple[str, ...], least: int = 4) -> list[tuple[str, list[str]]]:
    """The rules in groups, each with a text that all its rules need, so that one look does for most; rules that share none with two others are groups of their
    own with an empty text."""
    alone = {r: needed(r)[0] for r in rules if len(needed(r)) == 1}
    groups, left = [], list(rules)
    while alone:
        parts = {x[i:j] for x in alone.values() for i in range(len(x)) for j in range(i + least, len(x) + 1)}
        best = max(sorted(parts), key=lambda y: (sum(y in x for x in alone.values()), len(y)), default="")
        own = [r for r, x in alone.items() if best and best in x]
        if len(own) < 3:
            break
        groups.append((best, own))
        left, alone = [r for r in left if r not in own], {r: x for r, x in alone.items() if r not in own}
    return groups + [("", left)] * bool(left)


def _matches(c: Column, rules: list[str], group: int = 0, low: Column | None = None) -> Column:
    """The matches of all rules. A text is folded once (low, if the caller has done so), and searched for a rule only if it holds what every match of it has."""
    none = F.array().cast("array<string>")

    def each(low: Column, rules: tuple[str, ...]) -> Column:
        found = []
        for r in rules:
            got, needs = F.regexp_extract_all(c, F.lit("(?iU)" + hinted(r)), group), needed(r)
            found.append(F.when(~_has(low, needs), none).otherwise(got) if needs else got)
        return F.flatten(F.array(*found)) if len(found) > 1 else found[0]

    def all_(low: Column) -> Column:
        groups = [F.when(~low.contains(x), none).otherwise(each(low, own)) if x else each(low, own) for x, own in _grouped(tuple(check_rules(list(rules))))]
        return F.flatten(F.array(*groups)) if len(groups) > 1 else groups[0]

    return _bound(folded(c), all_) if low is None else all_(low)


def extract_rules(c: Column, rules: list[str], strip: list[str] = (), drop: list[str] = (), low: Column | None = None) -> Column:
    """Distinct matches of any rule, case-insensitive with Unicode word characters, in order; `strip` patterns are removed from each match, then
    empty matches and those in `drop` left out."""
    return _tidied(_matches(c, rules, low=low), strip, drop)


def any_rule(c: Column, rules: list[str], low: Column) -> Column:
    """Whether extract_rules would find anything: the first match of any rule settles it. low is the folded text."""

    def one(r: str) -> Column:
        pattern, needs = F.lit("(?iU)" + hinted(r)), needed(r)
        filled = _parsed(r) and _parsed(r).getwidth()[0] > 0
        got = F.regexp_like(c, pattern) if filled else F.exists(F.regexp_extract_all(c, pattern, 0), lambda m: m != "")
        return F.coalesce(_has(low, needs), F.lit(True)) & got if needs else got

    found = F.lit(False)
    for x, own in _grouped(tuple(check_rules(list(rules)))):
        some = reduce(lambda a, b: a | b, map(one, own))
        found = found | (F.coalesce(low.contains(x), F.lit(True)) & some if x else some)
    return F.coalesce(found, F.lit(False))


def _first_words(run: Column, most: int, before: int = 1) -> Column:
    """The run cut after its first, second, ... word, `most` words at most; `before` words that go ahead of these are in every cut."""
    w = F.split(run, " ")
    return F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(w) - before)), lambda n: F.array_join(F.slice(w, 1, n + before), " "))


def substations(c: Column, low: Column | None = None) -> Column:
    """Names of substations: "se" with one to three words, and with one to four that a number follows. As nothing marks where a name ends, every length is a
    name, and what belongs to none is stripped afterwards."""

    def names(runs: Column) -> Column:
        plain = F.flatten(F.transform(runs, lambda r: _first_words(r, 3)))
        numbered = F.flatten(F.transform(F.filter(runs, lambda r: F.size(F.split(r, " ")) > 2), lambda r: _first_words(r, 4, 2)))
        numbered = F.filter(F.transform(numbered, lambda m: F.regexp_extract(m, r"(?U)^.* [0-9]+(?=[^ ]*$)", 0)), lambda m: m != "")
        return F.concat(plain, numbered)

    return _tidied(_bound(_matches(c, [SUBSTATION_RUN], 1, low), names), SUBSTATION_STRIP, SUBSTATION_DROP)


def plants(c: Column, low: Column | None = None) -> Column:
    """Names of power plants: a kind with one to three words, every length a name, with the plant's number if there is one, and some fixed phrases."""
    kind = lambda r: F.struct(r.alias("run"), F.regexp_extract(r, "(?i)^" + _KIND, 0).alias("kind"))
    tails = lambda s: F.transform(_first_words(F.substring(s["run"], F.length(s["kind"]) + 1, F.length(s["run"])), 3), lambda tail: F.concat(s["kind"], tail))
    named = F.flatten(F.transform(F.transform(_matches(c, [PLANT_RUN], 1, low), kind), tails))
    return _tidied(F.concat(named, _matches(c, PLANT_RULES, low=low)), PLANT_STRIP)


# Phrases that compare, longest first; units of measured values.
MATH_PHRASES = ["inferior ou igual à", "superior ou igual à", "igual ou superior à", "igual ou inferior à", "inferior ou igual a", "superior ou igual a", "igual ou superior a", "igual ou inferior a", "superior ou igual", "inferior ou igual", "igual ou superior", "igual ou inferior", "menor ou igual à", "maior ou igual à", "igual ou menor à", "igual ou maior à", "menor ou igual a", "maior ou igual a", "igual ou menor a", "igual ou maior a", "igual ou menor", "igual ou maior", "menor ou igual", "maior ou igual", "superior à", "inferior à", "superior a", "inferior a", "superior", "inferior", "no mínimo", "no máximo", "no minimo", "no maximo", "entre"]
MATH_SIGNS = ["+", ">", "<", "=", "≥", "≤"]
UNITS = ["kva", "kv", "kw", "mw", "mvar", "hz", "ugs", "ug", "graus", "°", "º"]
#: One alternation instead of a rule for each unit and way of writing the number. Digits are taken all or none: what follows them begins with none.
VALUE_RULES = [r"\d(?<!\d\d)\d*+(?:\s?[.,]\s?\d++)?(?: \( \w+ \))? ?(?:" + "|".join(UNITS) + r")(?!\w)"]
MATH_RULES = ["[" + "".join(MATH_SIGNS) + "]", r"\b(?:" + "|".join(MATH_PHRASES) + r")\b"]
# A line: prefix, voltage, and one to four words on each side of a slash, joined by a point or space.
_PLACE = r"\w+(?:[. ]\w+){0,3}?"
LINE_RULES = [rf"\blts? \d+ kv {_PLACE} / \w+(?:[. ]\w+){{0,3}}"]
LINE_STRIP = ["com derivação(?: para)?", "a partir(?: da)?", " com", "e manter(?: o)?", "fique submetida(?: a)?", " fique", "(?:des)?energiza(?:ção|cao).*"]
_VOLTAGES = r"\d+ kv(?: ?, \d+ kv)?(?: e \d+(?:,\d+)? kv)?"
CAPACITOR_RULES = [rf"\b(?:bancos de capacitores|capacitores|cp) de {_VOLTAGES}"]
#: Transformers: ratings of two or three voltages with a place behind, and by name or abbreviation with a rating of two or three voltages.
_RATIO = r"[0-9]+ ?/ ?[0-9]+(?: ?/ ?[0-9]+)?"
TRANSFORMER_RULES = [rf"\ba?trs? {_RATIO}(?: kv)?" + place for place in (r" \w+", r" \w+[. ]\w+", r" \w+[. ]\w+[. ]\w+")]
TRANSFORMER_RULES += [rf"\b(?:(?:auto)?transformador(?:es)?|a?trs?) {_RATIO}(?: ?[.,] ?[0-9]+)? kv(?: - [0-9]+ mva)?"]
TRANSFORMER_STRIP = ["(?:des)?energiza(?:ção|cao).*"]

#: "se" and the words behind it, five at most. Every "se" begins a run of its own, also inside another's.
SUBSTATION_RUN = r"\b(?=(se(?: \w+){1,5}))"
# Parts of matches that belong to no name, removed in order, and what counts as nothing once they are gone.
SUBSTATION_STRIP = ["se especificados são iguais à [0-9]+", "se especificados são iguais a [0-9]+", "se especificados sao iguais a [0-9]+", "se especificados são iguais à", "se especificados são iguais a", "se especificados sao iguais a", "se especificados são iguais", "se especificados sao iguais", "se especificados são", "se especificados sao", "se especificados", "se as condições especificadas", "se as condicoes especificadas", "se as condicões", "se as condicoes", "se auto iniciando pelo", "se tratar de manobras", "se  iniciando pelo", "se  pelo terminal", "se auto iniciando", "se  iniciando", "se  pelo", "se onde", "se tratar de", "se tratar", "se transformador e realizado", "se transformador em sentido", "se transformador em", "transformador 2", "transformador", "autotransformador", "ângulo máximo em", "ângulo máximo para", "ângulo máximo", "angulo maximo em", "angulo maximo para", "angulo maximo", "inferior ou igual", "inferior ou i", "inferior ou", "sentido do [1-9]", "sentido do", "sentido da", "sentido", "esteja", "energização", "energizacao", "tensão na", "tensao na", "e para", "kv [1-9]+", "lt [1-9]+", " [1-9][1-9][1-9]", "sobrecarga nas 0", "superior à [0-9]+", "superior a [0-9]+", "com folga", " e proibida", " de forma", " auto ljat [0-9]+", " auto ljat", "se houver"]
SUBSTATION_DROP = ["", " ", "s", "se", "se as", "se ", "se  ", " se", "sa", "sis", "se  e"]

# Kinds of plants, and numbers that are no part of a plant's name.
PLANT_KINDS = ["uhe / se", "uhe", "pch", "ufv", "utn", "ute", "usinas?"]
PLANT_STRIP = ["[0-9]+ hz", "[0-9]+ kv", "[0-9][0-9]", "[0-9][0-9][0-9]"]
_KIND = "(?:" + "|".join(PLANT_KINDS) + ")"
#: A kind and one to three words of letters; the same with the plant's number behind; several plants of a name at once, and what is no one plant.
PLANT_RUN = rf"\b(?=({_KIND}(?: [a-zA-Z]+){{1,3}}))"
PLANT_RULES = [rf"\b{_KIND}(?: [a-zA-Z]+){{1,3}}(?: [0-9] | i{{1,3}}\b| iv\b)", r"\b(?:uhe|utn|ute|ufv)s? \w+ [0-9]+ e [0-9]+", "usinas? e[oó]licas?"]

#: States: words in every gender and number, with and without accents.
_ADJECTIVES = ["ligad", "fechad", "desligad", "conectad", "desconectad", "sincronizad", "interligad", "inserid", "sobrecarregad", "abert", "energizad", "desenergizad", "ajustad", "bloquead"]
STATE_RULES = [rf"\b(?:{'|'.join(_ADJECTIVES)})[oa]s?\b"]
# States of several words, and of one form.
STATE_RULES += [r"condi[cç][oõ]es especificadas na \w+-\w+ ?\. ?\w+ ?\. ?\w+", r"\bindispon[ií]ve(?:l|is)\b", r"\bindisponibilidade\b", r"ltc na posi[cç][aã]o [0-9]+\w+", "com indisponibilidade", "fluxo de pot[eê]ncia ativa", "indisponibilidade simples", "fluxo nulo no transformador", "independente das condi[cç][oõ]es operativas da ute", "em opera[cç][aã]o", "fora d[ea] opera[cç][aã]o", "conectado para ser energizado", "carga ativa em pelo menos um dos circuitos", "restri[cç][aã]o de regime permanente", "baipassado", "energizado em vazio", "em opera[cç][aã]o autom[aá]tica", r"\bsobrecarga\b", "sem carga", "em carga", "em vazio", "fluxo nulo", "com folga", "em s[eé]rie", "sob carga", "modo autom[aá]tico", "em carregamento", "em barramento", "em um barramento", "opere sozinha em um barramento", "energizado juntamente com a ltb", "energizado em pelo menos um circuito", "dispon[ií]vel para ser sincronizad[oa]"]

#: Inequalities: quantity, comparison and value as three alternations in one rule, not their product.
_QUANTITY = r"(?:Tens[aã]o(?: pr[eé]-manobra)? \w+ SE(?: \w+){1,4}|Tens[aã]o \w+ SE (?:onde|que) (?:se )?inicia a manobra|Tens[aã]o de pr[eé]-energiza[cç][aã]o|Tens[aã]o(?: na \w+)?|SE(?: \w+){1,3}|UHE(?: \w+){1,4}|(?:Diferença|Defasagem) angular(?: de)?|V ?\(\w+(?: \w+){0,2}\)|Δ(?:V|ϴ|δ)|(?<= )(?:δ|V))"
_COMPARED = r"(?:[><=≥≤]|(?:inferior|superior) ou igual \w+|igual(?: ou (?:superior|inferior))? \w+|(?:superior|inferior) \w+|no m[ií]nimo|no m[aá]ximo|entre|deve ser (?:[><=≥≤]|(?:inferior|superior|menor|maior)(?: ou igual)? \w+|no m[aá]ximo))"
_AMOUNT = r"[0-9]+ ?(?:kv|kw|mw|mvar|hz|°|º|graus|%)"
INEQUALITY_RULES = [
    rf"{_QUANTITY} {_COMPARED} {_AMOUNT}",
    r"[0-9]+ kV ≤ (?:Tens[aã]o \w+ SE(?: \w+){1,4}|V ?\(\w+(?: \w+){0,2}\)|V ?\w+(?: \w+){0,2})(?: ≤ [0-9]+ kV)?(?: V ?\(\w+(?: \w+)?\) ≥ [0-9]+ kV)?",
    r"\w+ - VBarra entre (?:\+ )?[0-9]+ kV e (?:- )?[0-9]+ kV",
    r"variação de potência reativa de até (?:[+-] )?[0-9]+ Mvar",
    r"UHE(?: \w+){1,4} deve estar com o mínimo de [0-9]+ unidades sincronizadas",
    r"SE(?: \w+){1,4} com folga para um fornecimento de no mínimo [0-9]+ Mvar",
]

#: Labels whose entities are the matches of rules as they stand.
PLAIN_RULES = {"VALOR_COM_UNID.MEDIDA": VALUE_RULES, "OPERADOR_MATEMATICO": MATH_RULES, "CP": CAPACITOR_RULES, "ESTADO_OPERATIVO": STATE_RULES, "INEQUACAO": INEQUALITY_RULES}

#: Each takes a text and, where several are asked, its folded form.
EXTRACTORS = {
    "VALOR_COM_UNID.MEDIDA": lambda c, low=None: extract_rules(c, VALUE_RULES, low=low),
    "OPERADOR_MATEMATICO": lambda c, low=None: extract_rules(c, MATH_RULES, low=low),
    "LT": lambda c, low=None: extract_rules(c, LINE_RULES, LINE_STRIP, low=low),
    "TR": lambda c, low=None: extract_rules(c, TRANSFORMER_RULES, TRANSFORMER_STRIP, low=low),
    "CP": lambda c, low=None: extract_rules(c, CAPACITOR_RULES, low=low),
    "SUBESTACAO": substations,
    "USINA": plants,
    "ESTADO_OPERATIVO": lambda c, low=None: extract_rules(c, STATE_RULES, low=low),
    "INEQUACAO": lambda c, low=None: extract_rules(c, INEQUALITY_RULES, low=low),
}


def equipments(c: Column) -> Column:
    """Transformers, lines and capacitors."""
    return F.array_distinct(F.concat(*(EXTRACTORS[k](c) for k in ("TR", "LT", "CP"))))


# Abbreviations and endings that a point belongs to; U+0002 stands for a point that ends nothing.
_APART, _ENDS = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Each begins with a look at the next letters, which most places fail.
_KEEP = [(r"(?=[MSDJICLPaf])" + _APART + r"(Mr|St|Mrs|Ms|Dr|Sr|Sra|Jr|Inc|Ltd|Co|Ph|art|fig)\.", "$1\u0002"), (r"\.(com|net|org|io|gov)" + _ENDS, "\u0002$1"), (r"\.(?=[0-9])(?<=[0-9]\.)", "\u0002"), (r"(?=\p{Lu}\.)" + _APART + r"(\p{Lu})\.(?=\s?\p{Lu})", "$1\u0002"), (r"(?=\p{L}\. )(?<=\s)(\p{L})\.", "$1\u0002")]


def split_sentences(c: Column, min_len: int = 3) -> Column:
    """Sentences that end in a point, question or exclamation mark, of more than min_len characters; points of abbreviations, initials, numbers and web
    names end nothing, a closing quote stays with its sentence, and what follows the last end is dropped."""
    text = replace_all(F.concat(F.lit(" "), F.regexp_replace(c, r"[\n)]", " "), F.lit("  ")), _KEEP)
    marked = F.regexp_replace(text, r"([.?!])([\"”]?)", "$1$2\u0001")
    pieces = F.split(marked, "\u0001")
    whole = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda s: F.trim(F.replace(s, F.lit("\u0002"), F.lit("."))))
    return F.filter(whole, lambda s: F.length(s) > min_len)


def split_sections(c: Column, heading: str = r"(?m)^\s*(\d+(?:\.\d+)*)\.?\s") -> Column:
    """Sections by numbered headings: structs of section number and text, the last included; text before the first heading has an empty number."""
    names = F.concat(F.array(F.lit("")), F.regexp_extract_all(c, F.lit(heading), 1))
    parts = F.split(c, heading)
    return F.filter(F.transform(F.arrays_zip(names.alias("section"), parts.alias("text")), lambda x: F.struct(x["section"].alias("section"), F.regexp_replace(x["text"], r"^\s+|\s+$", "").alias("text"))), lambda x: (x["section"] != "") | (x["text"] != ""))


def split_actions(c: Column) -> Column:
    """Pieces between six spaces, empty ones left out; null where there are no six spaces."""
    gap = " " * 6
    return F.when(c.contains(gap), F.filter(F.split(c, gap), lambda x: F.trim(x) != ""))


def contains_all(items: Column, pattern: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, pattern)), items)) == 0


def sku_from_name(c: Column) -> Column:
    """The part of a file name before the first underscore; without one before the first dash, space or point."""
    return F.when(c.contains("_"), F.split_part(c, F.lit("_"), F.lit(1))).when(c.contains("-"), F.split_part(c, F.lit("-"), F.lit(1))).when(c.contains(" "), F.split_part(c, F.lit(" "), F.lit(1))).otherwise(F.split_part(c, F.lit("."), F.lit(1)))
