"""Text, spans and vectors over documents, pages, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import neighbours as N
from millrace.operators import spans as S
from millrace.operators import vocabulary as V
from millrace.operators.lineage import spread
from millrace.plans.registry import Registry

R = Registry()


def docs(t):
    return t("documents").select("doc_id", "text")


@R.query("k1_normalize_marks", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '§', ' ENTER ', 'g'), '["-]', '', 'g'), '\*', ' ', 'g'), '[/.,;]', ' punkt ', 'g')) AS h FROM documents""")
def _(t):
    return docs(t).select("doc_id", F.md5(T.normalize_marks(F.col("text"))).alias("h"))


_STOP = ["de", "la", "the", "of", "und", "et"]


@R.query("k2_tokenize", r"""SELECT doc_id, len(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '' AND w NOT IN ('de','la','the','of','und','et'))) AS n, len(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '' AND w NOT IN ('de','la','the','of','und','et') AND NOT regexp_full_match(w, '\p{L}+'))) AS nums FROM documents""")
def _(t):
    d = docs(t).select("doc_id", T.tokenize(F.col("text"), _STOP).alias("w"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("n"), F.size(F.filter("w", lambda x: x == "#NUM")).cast("bigint").alias("nums"))


_TERMS = r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents"
_TOP = f"SELECT term, count(*) c, count(DISTINCT doc_id) df FROM ({_TERMS}) GROUP BY 1 ORDER BY c DESC, term LIMIT 12"


@R.query("k3_bag_of_words", f"SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS total, coalesce(count(n), 0) AS kinds FROM documents d LEFT JOIN (SELECT doc_id, term, count(*) n FROM ({_TERMS}) WHERE term IN (SELECT term FROM ({_TOP})) GROUP BY 1, 2) USING (doc_id) GROUP BY 1")
def _(t):
    model = V.BagOfWords(key="doc_id", text="text", max_features=12).fit(docs(t))
    cols, d = [F.col(f"`{c}`") for c in model.values["vocabulary"]], model.transform(docs(t))
    return d.select("doc_id", sum(cols[1:], cols[0]).cast("bigint").alias("total"), sum(((c > 0).cast("bigint") for c in cols[1:]), (cols[0] > 0).cast("bigint")).alias("kinds"))


@R.query("k4_tf_idf", f"""WITH top AS ({_TOP}), n AS (SELECT count(*) n FROM documents), w AS (SELECT doc_id, term, (1 + ln(count(*))) * (ln((1 + max(n)) / (1 + max(df))) + 1) AS w FROM ({_TERMS}) JOIN top USING (term), n GROUP BY 1, 2),
    s AS (SELECT doc_id, sum(w) / sqrt(sum(w * w)) AS s FROM w GROUP BY 1) SELECT doc_id, round(coalesce(s, 0), 6) AS s FROM documents LEFT JOIN s USING (doc_id)""")
def _(t):
    model = V.TfIdf(key="doc_id", text="text", max_features=12).fit(docs(t))
    cols = [F.col(f"`{c}`") for c in model.values["vocabulary"]]
    return model.transform(docs(t)).select("doc_id", F.round(sum(cols[1:], cols[0]), 6).alias("s"))


def _in_duck(x: str, rules: list[tuple[str, str]]) -> str:
    """The rules as nested calls of DuckDB's regexp_replace. Its patterns know neither what stands around a match nor intersections: what follows or goes before
    is matched and put back, twice over, as matches may touch."""
    for pattern, to in rules:
        pattern, to, again = pattern.replace(r"[\p{Ll}&&[^s]]", r"[^\P{Ll}s]"), to.replace("$", "\\"), 1
        if pattern == r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})":
            pattern, to, again = r"(\p{Ll})(\p{Lu}\p{Ll})", r"\1 \2", 2
        if pattern in (T._BEFORE_MARK, T._BEHIND_MARK):
            sides = (f"[{T._WORDLIKE}]", f"[^{T._WORDLIKE}]")
            (a, b), to = sides if pattern == T._BEFORE_MARK else sides[::-1], r"\1 \2"
            pattern = f"({a})({b})".replace("'", "''")
        if pattern.endswith(r"(?=\s)"):
            pattern, to = pattern[: -len(r"(?=\s)")] + r"(\s)", to + r"\3"
        for _ in range(again):
            x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


_HEAD = "CAST(doc_id % 9 AS VARCHAR)"
_PARTS = ["", ".2.1. Objetivo3. a) módulo 5 ", None, " abdesenergização 12energização&#xa0;x\uf0b7 abcd-xyz execuçãoprocedimento | 1) fim.  ."]


@R.query("k5_clean_fragment", f"SELECT doc_id, md5(trim(array_to_string(list_filter(string_split({_in_duck(f"{_HEAD} || '{_PARTS[1]}' || text || '{_PARTS[3]}'", T.SPACED_RULES)}, '.'), lambda w: trim(w) <> ''), '.'))) AS h FROM documents")
def _(t):
    whole = F.concat((F.col("doc_id") % 9).cast("string"), F.lit(_PARTS[1]), "text", F.lit(_PARTS[3]))
    return docs(t).select("doc_id", F.md5(T.clean_fragment(whole)).alias("h"))


_DIGITS = r"regexp_replace(regexp_replace({}, '([0-9])\p{{L}}+([0-9])', '\1\2', 'g'), '([0-9])\p{{L}}+([0-9])', '\1\2', 'g')"


@R.query("k6_clean_equipment", "SELECT doc_id, " + _DIGITS.format("array_to_string(list_filter(list_slice(string_split(text, ' '), 1, greatest(len(string_split(text, ' ')) - 14, 0)), lambda w: w <> ''), ' ')") + " AS nome FROM (SELECT doc_id, '1a2bc3 ' || text AS text FROM documents)")
def _(t):
    return docs(t).select("doc_id", T.clean_equipment(F.concat(F.lit("1a2bc3 "), "text")).alias("nome"))


@R.query("k7_strip_tags", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS h FROM pages""")
def _(t):
    return t("pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("h"))


_RULES = [r"th[a-z]{2,5}", r"an[a-z]{2,3}"]


@R.query("k8_extract_rules", "SELECT doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(text, '(?i)th[a-z]{2,5}'), regexp_extract_all(text, '(?i)an[a-z]{2,3}')))) AS e FROM documents")
def _(t):
    return docs(t).select("doc_id", T.extract_rules(F.col("text"), _RULES).alias("e"))


def _instructions(t, once=False):
    """Operating sentences around the driver's numbers, so that every extractor has something to find. Keys are dealt to all cores before texts are made of them,
    `once` each number once and by number, so that what is distinct for a number is found without another shuffle."""
    k = F.col("o_orderkey")
    kv = F.element_at(F.array(*map(F.lit, ["138", "230", "500", "13,8"])), (k % 4 + 1).cast("int"))
    sign = F.element_at(F.array(*map(F.lit, ["menor ou igual a", ">", "superior a", "no máximo"])), (k % 4 + 1).cast("int"))
    parts = ["LT ", kv, " kV Norte", (k % 7).cast("string"), " / Sul Leste com derivação para Oeste. A tensão na barra deve ser ", sign, " ", (k % 90 + 10).cast("string"), " kV; capacitores de ", kv, " kV energizados, UHE Serra Azul em operação, frequência ", (k % 5 + 55).cast("string"), ",5 Hz. TR ", (k % 3 + 230).cast("string"), " / 138 kV Norte desenergizado. SE ", kv, " kV Centro"]
    keys = t("orders").select("o_orderkey")
    return (spread(keys, by=("o_orderkey",)).distinct() if once else spread(keys)).select("o_orderkey", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("text"))


# What the extractors should find in those sentences, as SQL over the same numbers. A voltage with decimals names no line, capacitor or whole substation.
_KV = "['138', '230', '500', '13,8'][o_orderkey % 4 + 1]"
_SIGN = "['menor ou igual a', '>', 'superior a', 'no máximo'][o_orderkey % 4 + 1]"
_RATED = "'TR ' || CAST(o_orderkey % 3 + 230 AS VARCHAR) || ' / 138 kV'"
_LINE = f"CASE WHEN o_orderkey % 4 < 3 THEN ['LT ' || {_KV} || ' kV Norte' || CAST(o_orderkey % 7 AS VARCHAR) || ' / Sul Leste '] ELSE [] END"
_BANKS = f"CASE WHEN o_orderkey % 4 < 3 THEN ['capacitores de ' || {_KV} || ' kV'] ELSE [] END"
_TRAFOS = f"[{_RATED}, {_RATED} || ' Norte', {_RATED} || ' Norte desenergizado']"
_FOUND = {
    "VALOR_COM_UNID.MEDIDA": f"list_sort(list_distinct([{_KV} || ' kV', CAST(o_orderkey % 90 + 10 AS VARCHAR) || ' kV', CAST(o_orderkey % 5 + 55 AS VARCHAR) || ',5 Hz', '138 kV']))",
    "OPERADOR_MATEMATICO": f"[{_SIGN}]",
    "LT": _LINE,
    "TR": _TRAFOS,
    "CP": _BANKS,
    # A number that a later rule takes away leaves the words on both sides of it.
    "SUBESTACAO": f"CASE o_orderkey % 4 WHEN 3 THEN ['SE 13'] WHEN 0 THEN ['SE', 'SE kV', 'SE kV Centro'] ELSE ['SE ' || {_KV}, 'SE ' || {_KV} || ' kV', 'SE ' || {_KV} || ' kV Centro'] END",
    "USINA": "['UHE Serra', 'UHE Serra Azul', 'UHE Serra Azul em']",
    "ESTADO_OPERATIVO": "['desenergizado', 'em operação', 'energizados']",
    "INEQUACAO": f"['tensão na barra deve ser ' || {_SIGN} || ' ' || CAST(o_orderkey % 90 + 10 AS VARCHAR) || ' kV']",
}

for _key, _label in {"k8a_lines": "LT", "k8b_transformers": "TR", "k8c_capacitors": "CP", "k8f_states": "ESTADO_OPERATIVO", "k8g_values_with_unit": "VALOR_COM_UNID.MEDIDA", "k8h_substations": "SUBESTACAO", "k8i_math_operators": "OPERADOR_MATEMATICO", "k8j_plants": "USINA", "k8k_inequalities": "INEQUACAO"}.items():

    @R.query(_key, f"SELECT o_orderkey, {_FOUND[_label]} AS e FROM orders")
    def _(t, label=_label):
        return _instructions(t).select("o_orderkey", T.EXTRACTORS[label](F.col("text")).alias("e"))


@R.query("k8d_equipments", f"SELECT o_orderkey, list_concat(list_concat({_TRAFOS}, {_LINE}), {_BANKS}) AS e FROM orders")
def _(t):
    return _instructions(t).select("o_orderkey", T.equipments(F.col("text")).alias("e"))


_PHRASES = "(SELECT DISTINCT unnest([string_split(lower(p_name), ' ')[1], lower(p_name), 'the', 'of the']) AS p FROM part)"


@R.query("k8e_match_rules", f"SELECT doc_id, list_sort(list(DISTINCT p)) AS entities FROM (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), ' ') || ' ' AS x FROM documents), (SELECT p, ' ' || array_to_string(list_filter(string_split_regex(p, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), ' ') || ' ' AS y FROM {_PHRASES}) WHERE contains(x, y) GROUP BY 1")
def _(t):
    rules = t("part").select(F.explode(F.array(F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1)), F.lower("p_name"), F.lit("the"), F.lit("of the"))).alias("p")).distinct()
    return S.match_rules(docs(t), "doc_id", "text", rules, "p")


_EACH = " UNION ALL ".join(f"SELECT '{label}' AS label, {found} AS e FROM orders" for label, found in _FOUND.items())


@R.query("k22_extract_all", f"SELECT label, count(*) AS n, sum(len(e)) AS entities FROM ({_EACH}) WHERE len(e) > 0 GROUP BY 1")
def _(t):
    d = S.extract_all(_instructions(t), "text")
    return d.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("entities")).alias("entities"))


_NAMES = "SELECT p_name AS text, ['e', 'en', 'ne'] AS ents FROM part"
_SPANS = f"SELECT text, ent AS entity, CAST(i AS INTEGER) AS start, CAST(i + length(ent) AS INTEGER) AS \"end\", 'X' AS label FROM (SELECT DISTINCT text, unnest(ents) AS ent FROM ({_NAMES})), range(0, 200) r(i) WHERE i <= length(text) - length(ent) AND substr(text, CAST(i AS INTEGER) + 1, length(ent)) = ent QUALIFY row_number() OVER (PARTITION BY text, start ORDER BY \"end\" DESC) = 1"


def _spans(t):
    d = t("part").select(F.col("p_name").alias("text"), F.array(*map(F.lit, ["e", "en", "ne"])).alias("ents")).distinct()
    return S.to_spans(d, "text", "ents", "X")


@R.query("k9_spans", _SPANS)
def _(t):
    return _spans(t)


@R.query("k10_non_overlapping", "WITH s AS (SELECT o_custkey AS k, CAST(min(o_orderkey % 40) AS INTEGER) AS start, CAST(min(o_orderkey % 40) + 3 AS INTEGER) AS \"end\" FROM orders GROUP BY 1) SELECT k, start, \"end\", 'A' AS label FROM s")
def _(t):
    s = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min(F.col("o_orderkey") % 40).cast("int").alias("start"))
    s = s.withColumns({"end": F.col("start") + 3, "label": F.lit("A")})
    inside = s.withColumns({"start": F.col("start") + 1, "end": F.col("end") + 5})
    return S.non_overlapping(s.unionByName(inside), "k")


@R.query("k11_span_text", "SELECT p_partkey, substr(p_name, 3, 4) AS e FROM part")
def _(t):
    return t("part").select("p_partkey", S.span_text(F.col("p_name"), F.lit(3), F.lit(7), offset=1).alias("e"))


_KEPT = [  # the points that end nothing, as DuckDB's patterns can say it
    (r"(^|[^\p{L}\p{N}_])(Mr|St|Mrs|Ms|Dr|Sr|Sra|Jr|Inc|Ltd|Co|Ph|art|fig)\.", "\\1\\2\x02"),
    (r"\.(com|net|org|io|gov)([^\p{L}\p{N}_])", "\x02\\1\\2"),
    *[(r"([0-9])\.([0-9])", "\\1\x02\\2")] * 2,
    *[(r"(^|[^\p{L}\p{N}_])(\p{Lu})\.(\s?\p{Lu})", "\\1\\2\x02\\3")] * 2,
    *[(r"(\s)(\p{L})\.( )", "\\1\\2\x02\\3")] * 2,
]
_SENTENCES = "regexp_replace({}, '[\n)]', ' ', 'g')"
_SENTENCES = "' ' || " + _SENTENCES + " || '  '"
for _a, _b in [*_KEPT, (r"([.?!])([\"”]?)", "\\1\\2\x01")]:
    _SENTENCES = "regexp_replace(" + _SENTENCES + ", '" + _a.replace("{", "{{").replace("}", "}}") + f"', '{_b}', 'g')"
_SENTENCES = f"list_filter(list_transform(string_split({_SENTENCES}, '\x01')[:-2], lambda s: trim(replace(s, '\x02', '.'))), lambda s: length(s) > 3)"
_SPEAK = "'Dr. A. B. Silva viu www.x.com.br em 3.5 h, fig. 2. ' || text || ' The end? \"Yes.\" No'"


def _spoken(t):
    return t("documents").withColumn("text", F.concat(F.lit("Dr. A. B. Silva viu www.x.com.br em 3.5 h, fig. 2. "), "text", F.lit(' The end? "Yes." No')))


@R.query("k12_split_sentences", f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, '|')) AS h FROM (SELECT doc_id, {_SENTENCES.format(_SPEAK)} AS s FROM documents)")
def _(t):
    return _spoken(t).select("doc_id", T.split_sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("h"))


@R.query("k13_sentence_table", f"SELECT lang, count(*) AS n, sum(length(s)) AS letters FROM (SELECT lang, unnest({_SENTENCES.format(_SPEAK)}) AS s FROM documents) GROUP BY 1")
def _(t):
    return S.sentence_table(_spoken(t), "text", ["lang"]).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("letters"))


@R.query("k14_split_sections", "SELECT p_partkey, ['1', '2.1'] AS s, ['name ' || p_name, 'type ' || p_type] AS x FROM part")
def _(t):
    d = t("part").select("p_partkey", F.concat(F.lit("1. name "), "p_name", F.lit("\n2.1 type "), "p_type").alias("text"))
    d = d.withColumn("r", T.split_sections(F.col("text")))
    return d.select("p_partkey", F.transform("r", lambda x: x["section"]).alias("s"), F.transform("r", lambda x: x["text"]).alias("x"))


@R.query("k15_split_actions", "SELECT p_partkey, CASE WHEN p_size > 25 THEN [p_name, p_brand] END AS a FROM part")
def _(t):
    gap = F.when(F.col("p_size") > 25, " " * 6).otherwise(" ")
    return t("part").select("p_partkey", T.split_actions(F.concat("p_name", gap, "p_brand")).alias("a"))


@R.query("k16_export_annotations", "SELECT 'doc_' || CAST(dense_rank() OVER (ORDER BY text) - 1 AS VARCHAR) || '.txt' AS \"File\", 0 AS \"Line\", start AS \"Begin Offset\", \"end\" AS \"End Offset\", label AS \"Type\" FROM (" + _SPANS + ") WHERE label <> 'Y'")
def _(t):
    return S.export_annotations(_spans(t), "text", "text", ["Y"])


_ITEMS = "SELECT user_id, CAST(ts AS DATE) d, list_sort(list(DISTINCT event_type)) x FROM events GROUP BY 1, 2"


@R.query("k17_association_rules", f"""WITH x AS ({_ITEMS}), n AS (SELECT count(*) n FROM x), e AS (SELECT user_id, d, unnest(x) i FROM x),
    one AS (SELECT i, count(*) c FROM e GROUP BY 1), two AS (SELECT a.i a, b.i b, count(*) c FROM e a JOIN e b USING (user_id, d) WHERE a.i < b.i GROUP BY 1, 2),
    three AS (SELECT a.i a, b.i b, f.i f, count(*) c FROM e a JOIN e b USING (user_id, d) JOIN e f USING (user_id, d) WHERE a.i < b.i AND b.i < f.i GROUP BY 1, 2, 3),
    s AS (SELECT [i] AS s, c FROM one UNION ALL SELECT [a, b], c FROM two UNION ALL SELECT [a, b, f], c FROM three), f AS (SELECT s, c FROM s, n WHERE c >= ceil(0.01 * n)),
    r AS (SELECT l.s AS l, list_sort(list_filter(w.s, lambda v: NOT list_contains(l.s, v))) AS r, w.c AS c, l.c AS lc FROM f w JOIN f l ON len(l.s) < len(w.s) AND len(list_filter(l.s, lambda v: NOT list_contains(w.s, v))) = 0)
    SELECT array_to_string(l, ',') AS antecedent, array_to_string(r, ',') AS consequent, round(r.c / n, 6) AS support, round(r.c / lc, 6) AS confidence, round((r.c / lc) / (f.c / n), 6) AS lift FROM r JOIN f ON f.s = r.r, n WHERE r.c / lc >= 0.1""")
def _(t):
    x = t("events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.collect_set("event_type").alias("items"))
    r = S.association_rules(x, "items", 0.01, 0.1, 0.0, max_len=3)
    return r.select(*(F.array_join(c, ",").alias(c) for c in ("antecedent", "consequent")), *(F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")))


@R.query("k18_contains_all", "SELECT user_id, d FROM (SELECT user_id, CAST(ts AS DATE) d, list(DISTINCT event_type) x FROM events GROUP BY 1, 2) WHERE list_contains(x, 'click') AND list_contains(x, 'view')")
def _(t):
    x = t("events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.collect_set("event_type").alias("items"))
    return x.where(T.contains_all(F.col("items"), ["click", "view"])).select("user_id", "d")


@R.query("k19_drop_empty", "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '(?i)thion')) > 0")
def _(t):
    return docs(t).where(F.size(T.extract_rules(F.col("text"), ["thion"])) > 0).select("doc_id")


@R.query("k20_span_metrics", "WITH g AS (SELECT DISTINCT p_name k, p_brand AS label, p_size AS s FROM part WHERE p_partkey % 3 > 0), p AS (SELECT DISTINCT p_name k, p_brand AS label, p_size AS s FROM part WHERE p_partkey % 4 > 0), j AS (SELECT label, count(*) FILTER (g.x = 1 AND p.x = 1) h, count(p.x) f, count(g.x) t FROM (SELECT *, 1 x FROM g) g FULL JOIN (SELECT *, 1 x FROM p) p USING (k, label, s) GROUP BY 1) SELECT label, round(coalesce(h / nullif(f, 0), 0), 6) AS p, round(coalesce(h / nullif(t, 0), 0), 6) AS r, round(coalesce(2 * (h / nullif(f, 0)) * (h / nullif(t, 0)) / nullif(h / nullif(f, 0) + h / nullif(t, 0), 0), 0), 6) AS f FROM j")
def _(t):
    d = t("part").select("p_partkey", F.col("p_name").alias("k"), F.col("p_brand").alias("label"), F.col("p_size").alias("start"), F.col("p_size").alias("end"))
    return S.span_metrics(d.where("p_partkey % 3 > 0"), d.where("p_partkey % 4 > 0"), ["k"]).select("label", *(F.round(c, 6).alias(c) for c in "prf"))


@R.query("k21_build_trainset", "SELECT DISTINCT text, lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def _(t):
    d = t("documents")
    return S.build_trainset([d.where("doc_id % 2 = 0"), d], ["text", "lang"])


@R.query("x2_sku_from_name", "SELECT s_suppkey, 'SKU' || CAST(s_suppkey AS VARCHAR) AS sku FROM supplier")
def _(t):
    sep = F.element_at(F.array(*map(F.lit, ["_", "-", " ", "."])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return t("supplier").select("s_suppkey", T.sku_from_name(F.concat(F.lit("SKU"), F.col("s_suppkey").cast("string"), sep, F.lit("foto.jpg"))).alias("sku"))


_Q = "SELECT vec_id q, embedding qe, label ql FROM embeddings WHERE vec_id % 50 = 0"


@R.query("v1_knn", f"SELECT q AS query, vec_id AS neighbour, round(d, 5) AS distance, CAST(row_number() OVER (PARTITION BY q ORDER BY d, vec_id) AS INTEGER) AS rank FROM (SELECT q, vec_id, sqrt(list_sum(list_transform(list_zip(qe, embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ^ 2))) AS d FROM ({_Q}), embeddings WHERE label <> ql) QUALIFY rank <= 5")
def _(t):
    e = t("embeddings")
    return N.knn(e.where("vec_id % 50 = 0"), e, 5, "vec_id", "embedding", "label").withColumn("distance", F.round("distance", 5))


@R.query("v2_l2_normalize", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) ^ 2))), 6) AS x FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", F.round(F.get(N.l2_normalize(F.col("embedding")), F.lit(0)), 6).alias("x"))


@R.query("n7_vector_distance", "SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ^ 2))), 5) AS d FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def _(t):
    a, b = t("embeddings").select("vec_id", "embedding"), t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return a.join(b, "vec_id").select("vec_id", F.round(N.euclidean(F.col("embedding"), F.col("e2")), 5).alias("d"))


queries, oracle_sql = R.queries, R.oracle_sql
