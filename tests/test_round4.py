"""Steps that must keep to bounds as tables grow, each with a case that its earlier form failed."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import spans as S
from millrace.plans import pipelines as P


def test_item_sets_are_made_once(spark, monkeypatch):
    plans, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or cut(d))
    d = spark.createDataFrame([("a b",), ("a b a",), ("",), (None,)], "text string").select(F.regexp_extract_all("text", F.lit("[a-z]"), 0).alias("items"))
    got = S.association_rules(d, "items", 0.5, 0.5, 0.5)
    assert [(r.antecedent, r.consequent, r.support) for r in got.collect()] == [(["a"], ["b"], 1.0), (["b"], ["a"], 1.0)]
    assert plans[0].count("regexp_extract_all(") == 1


def _odd_texts(pieces, n, seed=0):
    rng = random.Random(seed)
    return [("".join(rng.choice(pieces) + rng.choice((" ", " ", "", ".", ", ")) for _ in range(rng.randint(0, 20))),) for _ in range(n)] + [("",), (None,)]


_WORDS = ["LT 138 kV Norte", "/ Sul Leste", "com derivação para", "SE", "se ", "uhe belo monte ii", "UHE / SE", "usina eólica", "em operação", "em vazio", "energizado em vazio", "desligadas", "sem carga", "fluxo nulo", "13,8", "5 hz", "٣", "12", "kV", "Kv", "deſligado", "İnferior a", "ınferior", "superior a", "igual ou menor", ">", "≤", "TR 230 / 138 kv", "capacitores de 5 kV", "Tensão na", "V (x) ≤ 5 kV", "no máximo 30 graus", "ã", "indisponível", "10 hz"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_odd_texts(_WORDS, 1500), "text string").repartition(4).cache()


@pytest.mark.parametrize("rules", ["STATE_RULES", "MATH_RULES", "VALUE_RULES", "LINE_RULES", "TRANSFORMER_RULES", "CAPACITOR_RULES", "PLANT_RULES", "INEQUALITY_RULES"])
def test_hinted_and_grouped_rules_find_what_plain_ones_do(odd, rules):
    rules = getattr(T, rules)
    plain = F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*(F.regexp_extract_all("text", F.lit("(?iU)" + r), 0) for r in rules))), lambda m: m != "")))
    got = odd.select(T.extract_rules(F.col("text"), rules).alias("a"), plain.alias("b"))
    assert got.where(~F.equal_null("a", "b")).count() == 0 and got.where(F.size("b") > 0).count() > 0
    whether = odd.withColumn("low", T.folded(F.col("text"))).select(T.any_rule(F.col("text"), rules, F.col("low")).alias("a"), (F.size(plain) > 0).alias("b"))
    assert whether.where(F.col("a") != F.coalesce("b", F.lit(False))).count() == 0 and whether.where("a is null").count() == 0


def test_digits_taken_whole(spark):
    """Values are those of a rule that also tries the digits one by one, states those of a rule for each word."""
    d = spark.createDataFrame(_odd_texts([*_WORDS, "1", ",", "8 , 9", "kva", "ligadas", "interligado"], 1500, 1), "text string")
    plain = r"\d+(?:\s?[.,]\s?\d+)?(?: \( \w+ \))? ?(?:" + "|".join(T.UNITS) + r")(?!\w)"
    assert d.where(~F.equal_null(F.regexp_extract_all("text", F.lit("(?iU)" + plain), 0), F.regexp_extract_all("text", F.lit("(?iU)" + T.VALUE_RULES[0]), 0))).count() == 0
    each = F.flatten(F.array(*(F.regexp_extract_all("text", F.lit(rf"(?iU)\b{x}[oa]s?\b"), 0) for x in T._ADJECTIVES)))
    assert d.where(~F.equal_null(F.array_sort(each), F.array_sort(F.regexp_extract_all("text", F.lit("(?iU)" + T.STATE_RULES[0]), 0)))).count() == 0


def test_what_hints_and_groups_say():
    assert T.hinted(r"\ba?trs? x") == r"(?=[at])(?:\ba?trs? x)" and T.hinted(r"(?<= )[+-]1") == r"(?=[\+\-])(?:(?<= )[+-]1)"
    assert all(T.hinted(r) == r for r in (r"\w+ a", "a?", "(?:a|b*)", "[^a]b", r"\p{L}a", "[a-c]d"))
    assert T.needed("(?:x|y)z+ab(?: c)+") == ("ab c",)
    for rules in (T.STATE_RULES, T.MATH_RULES, ["ab", "b+"], []):
        groups = T._grouped(tuple(rules))
        assert sorted(r for _, own in groups for r in own) == sorted(rules) and all(x in T.needed(r)[0] for x, own in groups for r in own if x)


def test_cleaning_by_screens_is_plain_cleaning(spark):
    pieces = ["1.2.3", "2.1. ", "a) ", "(iv)", "módulo 5.", "Submodulo", "•", " - ", "–", "Objetivo3.", "&nbsp;", "&amp;lt;", "\u00a0", "abc-xy", "ab1", "Á", "xmanobra", "ablt ", "desenergização", "sdesenergização", "9energização", "aBc", "<span>", "chesf (cron)", "execuçãoprocedimentoitem", "passocoordenaçãocontrolecomando", "color:#ffffff", " | ", "|", "\n", "\t", "  ", ".", "..", "(", "'", "_", "/", "😀", "á", "ß"]
    d = spark.createDataFrame(_odd_texts(pieces, 3000, 2), "text string")
    for apart, rules in ((True, T.SPACED_RULES), (False, T.FRAGMENT_RULES)):
        assert d.where(~F.equal_null(T.clean_fragment(F.col("text"), apart=apart), T.clean_fragment(F.col("text"), rules))).count() == 0
    # Letters of two units are letters, as in the query's SQL.
    assert spark.createDataFrame([("𝐚𝐛,c",)], "text string").select(T.clean_fragment(F.col("text"))).first()[0] == "𝐚𝐛 , c"


def test_spans_within_the_row_are_those_of_tables(spark, odd):
    d = odd.distinct()
    found = S.extract_all(d, "text")
    parts = [S.to_spans(found.where(F.col("label") == label), "text", "entities", label).select("text", "start", "end", "label") for label in T.EXTRACTORS]
    want = S.non_overlapping(S.build_trainset(parts, ["text", "start", "end", "label"]), "text")
    got = S.label_spans(d, "text")
    assert got.dtypes == want.dtypes and got.count() > 1000 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_samples_are_shuffled_by_number_alone(spark, tmp_path):
    """Numbers are dealt once; texts, finds and spans stay where they are. A number that stands twice gives its texts once."""
    spark.range(40).select((F.col("id") % 20).alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    d = P.queries()["pl8_entity_samples"](spark, str(tmp_path))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and d._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert d.count() == d.distinct().count() and d.select("text").distinct().count() == 60
