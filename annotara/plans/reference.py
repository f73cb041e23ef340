"""Queries of the analytics operators over the whole tables, with their SQL.

Labels of a document are its section (one of several spellings, brought to
lower case) and, as a second label, whether its text is longer than 800 code
points; annotations are the whole-word places of concept labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annotara.functions import text as T
from annotara.operators import annotate, cluster, experiment, features, graph, hierarchy, metrics, similarity, trees
from annotara.plans import oracles
from annotara.session import cut, table
from annotara.sources import payloads, readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


R = lambda c, n=6: F.round(c, n)
TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
TF = f"toks as (select doc_id as doc, unnest({TOK}) as term from documents), tf as (select doc, term, count(*) as tf from toks group by 1, 2)"
NDOC = "(select count(*) from documents)"


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def counts(s: SparkSession, d: str) -> DataFrame:
    return features.term_counts(features.token_rows(docs(s, d), "doc_id", "text"))


# --- tokens, counts, tf-idf -------------------------------------------------


@query("tokens", f"select doc, term, tf from (with {TF} select * from tf)")
def q_tokens(s, d):
    return counts(s, d)


@query("document_frequency", f"with {TF} select term, count(*) as df from tf group by 1")
def q_df(s, d):
    return features.document_frequency(counts(s, d))


@query("frequent_terms_binary", f"with {TF}, k as (select term from tf group by 1 having count(*) >= 5 and count(*) <= 0.5 * {NDOC}) select doc, term, 1::bigint as tf from tf where term in (select term from k)")
def q_freq(s, d):
    return features.frequent_terms(counts(s, d), docs(s, d).count(), 5, 0.5, True).select("doc", "term", "tf")


_TFIDF = f"""df as (select term, count(*) as df from tf group by 1),
w0 as (select doc, term, tf * (ln((1.0::double + {NDOC}) / (1.0::double + df)) + 1.0) as w from tf join df using (term)),
w as (select doc, term, w / sqrt(sum(w * w) over (partition by doc)) as w from w0)"""


@query("tfidf", f"with {TF}, {_TFIDF} select doc, term, round(w, 6) as w from w")
def q_tfidf(s, d):
    return features.tfidf(counts(s, d), docs(s, d).count()).select("doc", "term", R("w").alias("w"))


@query("top_terms", f"with {TF}, {_TFIDF} select doc, rank, term, round(w, 4) as w from (select doc, term, w, row_number() over (partition by doc order by round(w, 9) desc, term) as rank from w) where rank <= 10")
def q_top(s, d):
    return features.top_terms(features.tfidf(counts(s, d), docs(s, d).count()), 10)


@query("ngrams", f"with t as (select doc_id as doc, {TOK} as t from documents), g as (select doc, t, unnest(range(1, len(t))) as i from t) select term, count(*) as n from (select t[i] || ' ' || t[i + 1] as term from g) group by 1")
def q_ngrams(s, d):
    return features.ngrams(docs(s, d), "doc_id", "text", 2).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


# --- feature scoring ----------------------------------------------------------

_LAB = "lab as (select doc_id as doc, 'section:' || lower(section) as label from documents where section is not null union all select doc_id, 'long' from documents where length(text) > 800)"
_CT = f"""{TF}, {_LAB}, nx as (select term, count(*) as nx from tf group by 1), ny as (select label, count(*) as ny from lab group by 1),
j as (select term, label, count(*) as n from tf join lab using (doc) group by 1, 2),
dense as (select term, label, nx, ny, coalesce(j.n, 0) as n11 from nx cross join ny left join j using (term, label)),
ct as (select term, label, n11, nx - n11 as n10, ny - n11 as n01, {NDOC} - nx - ny + n11 as n00 from dense),
f as (select term, label, n11::double as a, n10::double as b, n01::double as c, n00::double as e, (n11 + n10 + n01 + n00)::double as n from ct)"""


def labels(s: SparkSession, d: str) -> DataFrame:
    x = docs(s, d)
    one = x.filter("section is not null").select(F.col("doc_id").alias("doc"), F.concat(F.lit("section:"), F.lower("section")).alias("label"))
    return one.unionByName(x.filter(F.length("text") > 800).select(F.col("doc_id").alias("doc"), F.lit("long").alias("label")))


def summed(s: SparkSession, d: str, how: str, scaled: bool = False) -> DataFrame:
    return features.summed_scores(counts(s, d).select("doc", "term"), labels(s, d), docs(s, d).count(), how, scaled)


def table_of(s: SparkSession, d: str) -> DataFrame:
    return features.contingency(counts(s, d).select("doc", "term"), labels(s, d), docs(s, d).count())


@query("contingency", f"with {_CT} select term, label, n11, n10, n01, n00 from ct")
def q_ct(s, d):
    return table_of(s, d)


_NULL0 = lambda num, den: f"coalesce(({num}) / nullif({den}, 0), 0)"
_PL = lambda p: f"(case when {p} > 0 then {p} * log2({p}) else 0 end)"
_SC = {
    "gss": "a * e - c * b",
    "odds_ratio": _NULL0("a * e", "c * b"),
    "ngl": _NULL0("sqrt(n) * (a * e - c * b)", "sqrt((a + c) * (b + e) * (a + b) * (c + e))"),
    "mutual_info": _NULL0("n * a", "(a + c) * (a + b)"),
    "mutual_info_log": "coalesce(log2(nullif(n * a / nullif((a + c) * (a + b), 0), 0)), 0)",
    "fisher": _NULL0("(a/(a+c) - b/nullif(b+e,0)) * (a/(a+c) - b/nullif(b+e,0))", "(a*(1-a/(a+c))*(1-a/(a+c)) + (n-a)*(a/(a+c))*(a/(a+c)))/n + (b*(1-b/nullif(b+e,0))*(1-b/nullif(b+e,0)) + (n-b)*(b/nullif(b+e,0))*(b/nullif(b+e,0)))/n"),
    "gu": "coalesce(abs((a - b) / nullif(sqrt(greatest(((a + b) / n) * (1 - (a + b) / n), 0) * (1.0 / nullif(a + c, 0) + 1.0 / nullif(b + e, 0))), 0)) * a * (b + e) / nullif((a + c) * b, 0), 0)",
    "info_gain": f"coalesce(-{_PL('((a+c)/n)')} + {_PL('((b+e)/n)')} - ((a+b)/n) * (-{_PL('(a/nullif(a+b,0))')} - {_PL('((b+e)/n)')}) + (1 - (a+b)/n) * (-{_PL('(c/nullif(c+b,0))')} - {_PL('(e/nullif(c+b,0))')}), 0)",
}
for _name, _sql in _SC.items():

    @query(f"score_{_name}", f"with {_CT} select term, round(sum({_sql}), 4) as score from f group by 1")
    def _score(s, d, _name=_name):
        return summed(s, d, _name).select("term", R("score", 4).alias("score"))


_GSS = f"g as (select term, sum({_SC['gss']}) as score from f group by 1)"


@query("score_scaled", f"with {_CT}, {_GSS} select term, round((score - (select min(score) from g)) / (select max(score) - min(score) from g), 6) as score from g")
def q_scaled(s, d):
    return summed(s, d, "gss", True).select("term", R("score").alias("score"))


@query("k_best", f"with {_CT}, {_GSS} select term, score from g order by score desc, term limit 100")
def q_best(s, d):
    return features.k_best(summed(s, d, "gss"), 100)


@query("over_value", f"with {_CT}, {_GSS} select term, score from g where score > 1000")
def q_over(s, d):
    return features.over_value(summed(s, d, "gss"), 1000)


@query("union_top", f"with {_CT}, r as (select term, {_SC['gss']} as score, row_number() over (partition by label order by {_SC['gss']} desc, term) as r from f) select term, sum(score) as score from r where r <= 10 group by 1")
def q_union(s, d):
    return features.union_top(features.scores(table_of(s, d), "gss", per_label=True), 10)


@query("feature_filter", f"with {TF}, c as (select distinct term from tf where doc % 2 = 0), r as (select distinct term from tf where doc % 2 = 1) select term from c where term in (select term from r)")
def q_keep(s, d):
    t = counts(s, d)
    halves = [t.filter(F.pmod("doc", F.lit(2)) == i).select("term").distinct() for i in (0, 1)]
    return features.keep_features(*halves)


@query("label_weights", f"with {_LAB}, m as (select label, count(*)::double / {NDOC} as m from lab group by 1) select label, round(1 - m, 6) as inverse, round(1 / (m * (select count(*) from m)), 6) as balanced from m")
def q_lw(s, d):
    return features.label_weights(labels(s, d), docs(s, d).count()).select("label", R("inverse").alias("inverse"), R("balanced").alias("balanced"))


@query("class_weights", "with c as (select event_type as label, count(*) as n from events group by 1) select label, round((select sum(n) from c)::double / ((select count(*) from c) * n), 6) as weight from c")
def q_cw(s, d):
    return features.class_weights(table(s, d, "events"), "event_type").select("label", R("weight").alias("weight"))


# --- cleaning, strings, arrays ---------------------------------------------


@query("clean_text", r"select doc_id, regexp_replace(text, '[^\x00-\x7F]|\\', '', 'g') as v from documents")
def q_clean(s, d):
    return docs(s, d).select("doc_id", T.ascii_clean(F.col("text")).alias("v"))


@query("clean_for_query", r"select row_no, trim(regexp_replace(regexp_replace(regexp_replace(title, '[^\x00-\x7F]|\\', '', 'g'), '^\++', ''), '[?|$!#()\[\]]', '', 'g')) as v from geo_series")
def q_cq(s, d):
    return table(s, d, "geo_series").select("row_no", T.query_clean(F.col("title"), brackets=True).alias("v"))


@query("clean_passage")
def q_cp(s, d):
    return docs(s, d).select("doc_id", T.passage_clean(F.col("text")).alias("v"))


@query("normal_form")
def q_nfc(s, d):
    return docs(s, d).select("doc_id", T.nfc_clean(F.col("text")).alias("v"))


@query("drop_bracketed_short", r"select doc_id, regexp_replace(text, '\[.*\]', '') as v from documents where length(text) <= 200")
def q_db(s, d):
    return docs(s, d).filter(F.length("text") <= 200).select("doc_id", T.drop_bracketed(F.col("text")).alias("v"))


@query("drop_bracketed", r"select doc_id, regexp_replace(text, '\[.*\]', '', 'g') as v from documents")
def q_dba(s, d):
    return docs(s, d).select("doc_id", T.drop_bracketed(F.col("text")).alias("v"))


@query("word_span", "select doc_id, case when strpos(text, 'protein') > 0 then strpos(text, 'protein') - 1 else length(text) end as s, case when strpos(text, 'protein') > 0 then strpos(text, 'protein') + 6 else length(text) end as e from documents")
def q_ws(s, d):
    x = docs(s, d).select("doc_id", T.word_span(F.col("text"), F.lit("protein")).alias("x"))
    return x.select("doc_id", F.col("x.start").cast("bigint").alias("s"), F.col("x.end").cast("bigint").alias("e"))


@query("capital_first", "select row_no, upper(substr(lb, 1, 1)) || substr(lb, 2) as v from concepts")
def q_cap(s, d):
    return table(s, d, "concepts").select("row_no", T.capital_first(F.col("lb")).alias("v"))


_PIECES = "regexp_extract_all(w, '[^-/]*[-/]|[^-/]+')"
_LARGE = "regexp_extract(p, '^[^\\p{L}\\p{N}_]*') || upper(substr(p, length(regexp_extract(p, '^[^\\p{L}\\p{N}_]*')) + 1, 1)) || substr(p, length(regexp_extract(p, '^[^\\p{L}\\p{N}_]*')) + 2)"
_SMALL = "('a', 'an', 'and', 'as', 'at', 'but', 'by', 'en', 'for', 'if', 'in', 'of', 'on', 'or', 'the', 'to', 'v', 'v.', 'via', 'vs', 'vs.')"


@query("kept_title", f"""with w as (select row_no, lb, string_split(lb, ' ') as ws from concepts), e as (select row_no, len(ws) as n, unnest(ws) as w, generate_subscripts(ws, 1) as i, ws from w),
t as (select row_no, i, case when (lower(w) in {_SMALL} and i > 1 and i < n and not regexp_matches(ws[i - 1], '[:.;?!—-]$')) or regexp_matches(w, '[a-zA-Z]+[A-Z]') or regexp_matches(w, '[a-zA-Z][.][a-zA-Z]') then w
  else array_to_string(list_transform({_PIECES}, lambda p: {_LARGE}), '') end as v from e)
select c.row_no, x.v from concepts c left join (select row_no, string_agg(v, ' ' order by i) as v from t group by 1) x using (row_no)""")
def q_title(s, d):
    return table(s, d, "concepts").select("row_no", T.kept_title(F.col("lb")).alias("v"))


@query("match_pairs", "select row_no, coalesce(regexp_matches(lb, 'ase$'), false) or coalesce(regexp_matches(onto, '^Q'), false) as any_hit, coalesce(regexp_matches(lb, 'ase$'), false) and coalesce(regexp_matches(onto, '^Q'), false) as all_hit from concepts")
def q_mp(s, d):
    a, b = F.array("lb", "onto"), F.array(F.lit("ase$"), F.lit("^Q"))
    return table(s, d, "concepts").select("row_no", T.match_pairs(a, b).alias("any_hit"), T.match_pairs(a, b, True).alias("all_hit"))


@query("string_similarity")
def q_sim(s, d):
    return table(s, d, "concepts").select("row_no", R(T.similarity(F.col("node_id"), F.col("lb"))).alias("v"))


_WORDS = "string_split(lb, ' ')"


@query("pad_list", f"select row_no, array_to_string(list_concat({_WORDS}, ['', '', '', ''])[1:4], '|') as v from concepts where lb is not null")
def q_pad(s, d):
    return table(s, d, "concepts").filter("lb is not null").select("row_no", F.array_join(T.pad_list(F.split("lb", " "), 4), "|").alias("v"))


@query("align_lists", "select row_no, array_to_string(list_concat(list_filter(['b', 'c', 'a'], lambda x: list_contains(string_split(node_id, ':'), x) ), list_filter(string_split(node_id, ':'), lambda x: not list_contains(['b', 'c', 'a'], x))), '|') as v from concepts")
def q_al(s, d):
    ref = F.array(F.lit("b"), F.lit("c"), F.lit("a"))
    return table(s, d, "concepts").select("row_no", F.array_join(T.align_lists(F.split("node_id", ":"), ref), "|").alias("v"))


@query("windows", "with w as (select row_no, string_split(title, ' ') as t from geo_series), i as (select row_no, t, unnest(range(1, len(t) + 1)) as i from w) select row_no, i, coalesce(t[i - 1], '0') || ' ' || t[i] || ' ' || coalesce(t[i + 1], '0') as v from (select row_no, i, list_concat(['0'], t, ['0']) as u, t from i) where i >= 1 and i <= len(t)".replace("coalesce(t[i - 1], '0') || ' ' || t[i] || ' ' || coalesce(t[i + 1], '0')", "u[i] || ' ' || u[i + 1] || ' ' || u[i + 2]"))
def q_win(s, d):
    x = table(s, d, "geo_series").select("row_no", F.posexplode(T.windows(F.split("title", " "), 1, F.lit("0"))).alias("i", "v"))
    return x.select("row_no", (F.col("i") + 1).cast("bigint").alias("i"), F.array_join("v", " ").alias("v"))


@query("context_windows", "with t as (select row_no, string_split(title, ' ') as t from geo_series where title is not null) select row_no, array_to_string(t[1:2], ' ') as l, array_to_string(list_reverse(t[2:len(t)]), ' ') as r from t")
def q_ctx(s, d):
    x = table(s, d, "geo_series").filter("title is not null").select("row_no", T.context(F.split("title", " "), F.lit(1), F.lit(1)).alias("c"))
    return x.select("row_no", F.array_join("c.left", " ").alias("l"), F.array_join("c.right", " ").alias("r"))


@query("chunks", "with t as (select row_no, string_split(title, ' ') as t from geo_series where title is not null), i as (select row_no, t, unnest(range(0, len(t), 3)) as i from t) select row_no, (i / 3)::bigint as i, array_to_string(list_concat(t, ['_', '_', '_'])[i + 1:i + 3], ' ') as v from i")
def q_chunks(s, d):
    x = table(s, d, "geo_series").filter("title is not null").select("row_no", F.posexplode(T.chunks(F.split("title", " "), 3, F.lit("_"))).alias("i", "v"))
    return x.select("row_no", F.col("i").cast("bigint").alias("i"), F.array_join("v", " ").alias("v"))


@query("space_spans")
def q_spans(s, d):
    return annotate.spans_of_tokens(docs(s, d), "doc_id", "text")


@query("token_locations")
def q_loc(s, d):
    return annotate.locate_tokens(docs(s, d), "doc_id", "text")


@query("drop_punctuation", "select row_no, array_to_string(list_filter(string_split(title, ' '), lambda t: strpos('!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', t) = 0), ' ') as v from geo_series where title is not null")
def q_punct(s, d):
    return table(s, d, "geo_series").filter("title is not null").select("row_no", F.array_join(T.drop_punctuation(F.split("title", " ")), " ").alias("v"))


@query("signed_labels", "select event_id, case when abs(value - 50) <= 20 then 0 else sign(value - 50)::int end as v from events")
def q_signed(s, d):
    return table(s, d, "events").select("event_id", T.signed_label(F.col("value") - 50, 20).alias("v"))


_ELEMENTS = "e as (select vec_id, list_sum(list_transform(embedding, lambda x: abs(x::double))) as n, list_sum(list_transform(embedding, lambda x: exp(x::double))) as m, unnest(embedding)::double as x, unnest(range(len(embedding)))::int as i from embeddings)"


@query("unit_vectors", f"with {_ELEMENTS} select vec_id, i, round(coalesce(x / nullif(n, 0), 0), 6) + 0.0 as x from e")
def q_unit(s, d):
    return table(s, d, "embeddings").select("vec_id", F.posexplode(T.unit_norm(F.col("embedding"))).alias("i", "x")).select("vec_id", "i", (R("x") + 0.0).alias("x"))


@query("softmax", f"with {_ELEMENTS} select vec_id, i, round(exp(x) / m, 6) as p from e")
def q_soft(s, d):
    return table(s, d, "embeddings").select("vec_id", F.posexplode(T.soft_max(F.col("embedding"))).alias("i", "p")).select("vec_id", "i", R("p").alias("p"))


# --- metrics ------------------------------------------------------------------

_PRED = "p as (select l_orderkey, l_returnflag as y, case when l_discount > 0.06 then 'R' when l_discount > 0.03 then 'A' else 'N' end as p, case when l_returnflag = 'R' then 1 else 0 end as t, l_discount * 100 + l_tax as s, l_linestatus as g from lineitem)"


def preds(s: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("l_discount") > 0.06, "R").when(F.col("l_discount") > 0.03, "A").otherwise("N")
    return table(s, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("y"), p.alias("p"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("t"), (F.col("l_discount") * 100 + F.col("l_tax")).alias("s"), F.col("l_linestatus").alias("g"))


@query("confusion", f"with {_PRED} select y, p, count(*) as n from p group by 1, 2")
def q_conf(s, d):
    return metrics.confusion(preds(s, d), "y", "p")


_REP = f"""{_PRED}, c as (select distinct y as label from p union select distinct p from p),
r as (select label, (select count(*) from p where y = label and p = label)::double as tp, (select count(*) from p where y = label)::double as sup, (select count(*) from p where p = label)::double as pp from c),
m as (select label, coalesce(tp / nullif(pp, 0), 0) as precision, coalesce(tp / nullif(sup, 0), 0) as recall, sup::bigint as support from r),
rep as (select label, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1, support from m)"""


@query("class_report", f"with {_REP} select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from rep")
def q_rep(s, d):
    return metrics.report(preds(s, d), "y", "p").select("label", R("precision").alias("precision"), R("recall").alias("recall"), R("f1").alias("f1"), "support")


@query("class_averages", f"with {_REP} select round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1, round(sum(recall * support) / sum(support), 6) as accuracy from rep")
def q_avg(s, d):
    a = metrics.averages(metrics.report(preds(s, d), "y", "p"))
    return a.select(*[R(c).alias(c) for c in a.columns])


@query("binary_scores", f"with {_PRED} select round(x.tp / x.pp, 6) as precision, round(x.tp / x.yy, 6) as recall, round(2 * x.tp / (x.pp + x.yy), 6) as f1 from (select sum(case when t = 1 and p = 'R' then 1 else 0 end)::double as tp, sum(case when p = 'R' then 1 else 0 end) as pp, sum(t) as yy from p) x")
def q_bin(s, d):
    b = metrics.binary_scores(preds(s, d).withColumn("q", F.when(F.col("p") == "R", 1).otherwise(0)), "t", "q")
    return b.select(*[R(c).alias(c) for c in b.columns])


_ROC = f"""{_PRED}, pts as (select {{by}} s as threshold, sum(t) as p, sum(1 - t) as n from p group by all),
curve as (select {{by}} threshold, sum(n) over (partition by {{one}} order by threshold desc)::double / sum(n) over (partition by {{one}}) as fpr, sum(p) over (partition by {{one}} order by threshold desc)::double / sum(p) over (partition by {{one}}) as tpr from pts)"""
_AUC = "a as (select {by} (fpr - lag(fpr, 1, 0) over (partition by {one} order by threshold desc)) * (tpr + lag(tpr, 1, 0) over (partition by {one} order by threshold desc)) / 2 as a from curve)"


@query("roc_curve", f"with {_ROC.format(by='', one='1')} select round(threshold, 6) as threshold, round(fpr, 6) as fpr, round(tpr, 6) as tpr from curve")
def q_roc(s, d):
    return metrics.roc(preds(s, d), "t", "s").select(*[R(c).alias(c) for c in ("threshold", "fpr", "tpr")])


@query("auc_by_group", f"with {_ROC.format(by='g,', one='g')}, {_AUC.format(by='g,', one='g')} select g, round(sum(a), 6) as auc from a group by 1")
def q_auc(s, d):
    return metrics.auc(metrics.roc(preds(s, d), "t", "s", ["g"]), ["g"]).select("g", R("auc").alias("auc"))


@query("precision_recall", f"with {_PRED}, pts as (select s as threshold, sum(t) as p, count(*) as m from p group by 1) select round(threshold, 6) as threshold, round(sum(p) over w::double / sum(m) over w, 6) as precision, round(sum(p) over w::double / sum(p) over (), 6) as recall from pts window w as (order by threshold desc)")
def q_prc(s, d):
    return metrics.precision_recall(preds(s, d), "t", "s").select(*[R(c).alias(c) for c in ("threshold", "precision", "recall")])


@query("macro_roc")
def q_macro(s, d):
    g = metrics.on_grid(metrics.roc(preds(s, d), "t", "s", ["g"]), ["g"])
    return g.groupBy(R("fpr").alias("fpr")).agg(R(F.avg("tpr")).alias("tpr"))


@query("example_based", "with s as (select o_orderkey, list_distinct([l_returnflag, l_linestatus]) as t, list_distinct([l_linestatus, case when l_discount > 0.05 then 'R' else 'N' end]) as p from lineitem join orders on l_orderkey = o_orderkey), m as (select len(list_intersect(t, p))::double as tp, len(list_distinct(list_concat(t, p))) as u, len(t) as a, len(p) as b from s) select round(avg(tp / u), 6) as accuracy, round(avg(tp / b), 6) as precision, round(avg(tp / a), 6) as recall, round(2 * avg(tp / b) * avg(tp / a) / (avg(tp / b) + avg(tp / a)), 6) as fscore from m")
def q_ex(s, d):
    x = table(s, d, "lineitem").select(F.array_distinct(F.array("l_returnflag", "l_linestatus")).alias("t"), F.array_distinct(F.array("l_linestatus", F.when(F.col("l_discount") > 0.05, "R").otherwise("N"))).alias("p"))
    e = metrics.example_based(x, "t", "p")
    return e.select(*[R(c).alias(c) for c in e.columns])


@query("model_overlaps")
def q_venn(s, d):
    x = table(s, d, "lineitem").select(*[F.when(c, 1).otherwise(0).alias(n) for n, c in (("m1", F.col("l_discount") > 0.05), ("m2", F.col("l_tax") > 0.04), ("m3", F.col("l_quantity") > 25), ("t", F.col("l_returnflag") == "R"))])
    return metrics.overlaps(x, ["m1", "m2", "m3"], "t")


@query("rank_correlation", "with r as (select avg(ra) over (partition by l_quantity) as ra, avg(rb) over (partition by l_extendedprice) as rb from (select l_quantity, l_extendedprice, row_number() over (order by l_quantity)::double as ra, row_number() over (order by l_extendedprice)::double as rb from lineitem)) select round(corr(ra, rb), 6) as rho from r")
def q_rho(s, d):
    return metrics.spearman(table(s, d, "lineitem"), "l_quantity", "l_extendedprice").select(R("rho").alias("rho"))


_CL = """t as (select l_returnflag as c, l_linestatus as k, count(*)::double as n from lineitem group by 1, 2), s as (select sum(n) as n from t),
a as (select c, sum(n) as a from t group by 1), b as (select k, sum(n) as b from t group by 1),
j as (select t.n as x, a.a, b.b, s.n as n from t join a using (c) join b using (k), s),
q as (select sum(x / n * ln(x * n / (a * b))) as mi, -sum(x / n * ln(x / b)) as hck, -sum(x / n * ln(x / a)) as hkc, sum(x * (x - 1) / 2) as s from j),
ea as (select -sum(a / n * ln(a / n)) as hc, sum(a * (a - 1) / 2) as sa from a, s), eb as (select -sum(b / n * ln(b / n)) as hk, sum(b * (b - 1) / 2) as sb from b, s),
pu as (select sum(m) / max(s.n) as purity from (select k, max(n) as m from t group by 1), s), z as (select n * (n - 1) / 2 as z from s)"""


@query("cluster_scores", f"with {_CL} select round(1 - hck / hc, 6) as homogeneity, round(1 - hkc / hk, 6) as completeness, round(2 * (1 - hck / hc) * (1 - hkc / hk) / ((1 - hck / hc) + (1 - hkc / hk)), 6) as v_measure, round(mi, 6) as mutual_info, round(2 * mi / (hc + hk), 6) as nmi, round(purity, 6) as purity, round((z + 2 * s - sa - sb) / z, 6) as rand, round((s - sa * sb / z) / ((sa + sb) / 2 - sa * sb / z), 6) as adjusted_rand, round(s / sqrt(sa * sb), 6) as fowlkes_mallows from q, ea, eb, pu, z")
def q_cls(s, d):
    x = metrics.cluster_scores(metrics.cluster_table(table(s, d, "lineitem"), "l_returnflag", "l_linestatus"))
    return x.select(*[R(c).alias(c) for c in x.columns])


@query("filter_clusters", "with x as (select vec_id as doc, label as cluster, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as f from embeddings), s as (select cluster, avg(s) as s from (select cluster, f, stddev_pop(v) as s from x group by 1, 2) group by 1) select vec_id as doc, case when s > 0.1 then -1 else label end as cluster from embeddings join s on label = cluster")
def q_fc(s, d):
    x = table(s, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("label").alias("cluster"), F.posexplode("embedding").alias("feat", "val"))
    return metrics.filter_clusters(x.withColumn("val", F.col("val").cast("double")), 0.1)


@query("log_loss", "select round(avg(-(case when l_returnflag = 'R' then ln(least(greatest(l_discount * 5, 1e-7), 1 - 1e-7)) else ln(1 - least(greatest(l_discount * 5, 1e-7), 1 - 1e-7)) end)), 5) as loss from lineitem")
def q_ll(s, d):
    y = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    return table(s, d, "lineitem").agg(R(F.avg(metrics.weighted_log_loss(y, F.col("l_discount") * 5)), 5).alias("loss"))


# --- experiment ---------------------------------------------------------------

_H = "('0x' || substr(md5({k} || ':{seed}'), 1, 8))::bigint"


@query("folds", f"select doc_id, ({_H.format(k='doc_id', seed=0)} % 5)::int as fold from documents")
def q_folds(s, d):
    return experiment.folds(docs(s, d), "doc_id", 5).select("doc_id", "fold")


@query("stratified_folds", f"select event_id, ((row_number() over (partition by event_type order by {_H.format(k='event_id', seed=0)}, event_id) - 1) % 5)::int as fold from events")
def q_sfolds(s, d):
    return experiment.stratified_folds(table(s, d, "events"), "event_id", "event_type", 5).select("event_id", "fold")


@query("sample_share", f"select event_id from events where {_H.format(k='event_id', seed=3)} < 0.1 * 4294967296")
def q_share(s, d):
    return experiment.sample(table(s, d, "events"), "event_id", frac=0.1, seed=3).select("event_id")


@query("sample_per_key", f"select event_id from (select event_id, row_number() over (partition by event_type order by {_H.format(k='event_id', seed=0)}, event_id) as r from events) where r <= 20")
def q_perkey(s, d):
    return experiment.sample(table(s, d, "events"), "event_id", n=20, by="event_type").select("event_id")


@query("rebalance")
def q_reb(s, d):
    x = table(s, d, "events").withColumn("y", F.when(F.col("value") > 95, 1).otherwise(0))
    return experiment.rebalance(x, "event_id", "y", 3.0).select("event_id", "y")


@query("fold_summary", f"with x as (select ({_H.format(k='event_id', seed=0)} % 5) as fold, event_type as model, avg(value) as v from events group by 1, 2) select model, 'value' as metric, round(avg(v), 5) as mean, round(stddev_pop(v), 5) as std from x group by 1")
def q_fsum(s, d):
    x = experiment.folds(table(s, d, "events"), "event_id", 5).groupBy("fold", F.col("event_type").alias("model")).agg(F.avg("value").alias("value")).withColumn("metric", F.lit("value"))
    return experiment.fold_summary(x).select("model", "metric", R("mean", 5).alias("mean"), R("std", 5).alias("std"))


@query("histogram", "with b as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders), x as (select least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)::int as bin, count(*) as n from orders, b group by 1) select bin, n, sum(n) over (order by bin)::bigint as cumulative from x")
def q_hist(s, d):
    return experiment.histogram(table(s, d, "orders"), "o_totalprice", 20)


@query("model_predictions")
def q_models(s, d):
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = table(s, d, "embeddings").select(F.col("vec_id").alias("doc"), array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"), (F.col("label") % 2).cast("double").alias("label"))
    x = experiment.folds(x, "doc", 3)
    return experiment.cross_validate(x, lambda: [("tree", DecisionTreeClassifier(maxDepth=4, impurity="entropy", seed=1)), ("linear", LogisticRegression(maxIter=5))], 3)


@query("tree_importance")
def q_imp(s, d):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    x = table(s, d, "embeddings").select(array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"), F.col("label").cast("double").alias("label"))
    m = DecisionTreeClassifier(maxDepth=5, impurity="entropy", seed=1).fit(x)
    imp = m.featureImportances.toArray().tolist()
    return s.createDataFrame([(i, float(v)) for i, v in enumerate(imp)], "feat int, score double")


# --- distances and neighbours ---------------------------------------------------

_D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"


@query("near_pairs", f"select a.vec_id as i, b.vec_id as j, round(sqrt({_D2}), 5) as d from embeddings a join embeddings b on a.vec_id < b.vec_id where sqrt({_D2}) <= 1.2")
def q_near(s, d):
    return similarity.pair_distances(table(s, d, "embeddings"), "vec_id", "embedding", within=1.2).select("i", "j", R("d", 5).alias("d"))


@query("exact_neighbours", f"select i, r as rank, j, round(d, 5) as d from (select a.vec_id as i, b.vec_id as j, sqrt({_D2}) as d, row_number() over (partition by a.vec_id order by sqrt({_D2}), b.vec_id) as r from embeddings a, embeddings b where a.vec_id <> b.vec_id and a.vec_id % 50 = 0) where r <= 5")
def q_knn(s, d):
    x = table(s, d, "embeddings")
    return similarity.exact_neighbours(x.filter(F.pmod("vec_id", F.lit(50)) == 0), x, "vec_id", "embedding", 5).select("i", "rank", "j", R("d", 5).alias("d"))


@query("farthest", f"select i, r as rank, j, round(d, 5) as d from (select a.vec_id as i, b.vec_id as j, sqrt({_D2}) as d, row_number() over (partition by a.vec_id order by sqrt({_D2}) desc, b.vec_id) as r from embeddings a join embeddings b on a.vec_id < b.vec_id) where r <= 2")
def q_far(s, d):
    return similarity.top_k(similarity.pair_distances(table(s, d, "embeddings"), "vec_id", "embedding"), 2, True).select("i", "rank", "j", R("d", 5).alias("d"))


@query("scaled_pairs", "with p as (select n_nationkey as i, r_regionkey as j, (n_nationkey * 7 + r_regionkey * 3) % 11 as d from nation, region) select i, j, round((d - (select min(d) from p))::double / (select max(d) - min(d) from p), 6) as d from p")
def q_scaledp(s, d):
    n, r = table(s, d, "nation").withColumn("k", F.lit(1)), table(s, d, "region").withColumn("k", F.lit(1))
    p = n.join(r, "k").select(F.col("n_nationkey").alias("i"), F.col("r_regionkey").alias("j"), ((F.col("n_nationkey") * 7 + F.col("r_regionkey") * 3) % 11).alias("d"))
    return similarity.scale_pairs(p).select("i", "j", R("d").alias("d"))


def _order_values(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("feat")).agg(F.avg("o_totalprice").alias("val"))


@query("correlations", "with x as (select o_custkey as doc, o_orderpriority as feat, avg(o_totalprice) as val from orders group by 1, 2) select x.feat as a, y.feat as b, round(corr(x.val, y.val), 5) as r from x join x y on x.doc = y.doc and x.feat < y.feat group by 1, 2")
def q_corr(s, d):
    return similarity.correlations(_order_values(s, d)).select("a", "b", R("r", 5).alias("r"))


@query("correlations_dense", "with x as (select o_custkey as doc, o_orderpriority as feat, avg(o_totalprice) as val from orders group by 1, 2), f as (select distinct feat from x), g as (select doc, f.feat, coalesce(x.val, 0) as val from (select c_custkey as doc from customer) c cross join f left join x using (doc, feat)) select a.feat as a, b.feat as b, round(corr(a.val, b.val), 5) as r from g a join g b on a.doc = b.doc and a.feat < b.feat group by 1, 2")
def q_corr_dense(s, d):
    return similarity.correlations(_order_values(s, d), table(s, d, "customer").count()).select("a", "b", R("r", 5).alias("r"))


@query("dot_products", "with x as (select o_orderpriority as doc, o_custkey as feat, count(*) as val from orders group by 1, 2) select a.doc as i, b.doc as j, sum(a.val * b.val)::double as s from x a join x b on a.feat = b.feat and a.doc < b.doc group by 1, 2")
def q_dot(s, d):
    x = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("doc"), F.col("o_custkey").alias("feat")).agg(F.count(F.lit(1)).alias("val"))
    return similarity.dot_products(x)


@query("unique_cells", "select l_returnflag as row, l_linestatus as col, sum(l_quantity) as val from lineitem group by 1, 2")
def q_cells(s, d):
    x = table(s, d, "lineitem").select(F.col("l_returnflag").alias("row"), F.col("l_linestatus").alias("col"), F.col("l_quantity").alias("val"))
    return similarity.unique_cells(x, "sum")


@query("blended_pairs")
def q_blend(s, d):
    x = table(s, d, "embeddings")
    base = similarity.pair_distances(x, "vec_id", "embedding")
    cons = similarity.constraint_distances(x.select("vec_id", F.slice("embedding", 1, 4).alias("c")), "vec_id", "c")
    return similarity.top_k(similarity.blend_pairs(base, [cons], 0.5), 3).select("i", "rank", "j", R("d", 5).alias("d"))


# --- clustering ---------------------------------------------------------------


@query("fuzzy_means")
def q_fcm(s, d):
    m, _ = cluster.fuzzy_means(table(s, d, "embeddings"), "vec_id", "embedding", 4, rounds=5, error=0.0)
    return m.select("doc", "cluster", R("u").alias("u"))


def _near(s: SparkSession, d: str) -> DataFrame:
    p = similarity.pair_distances(table(s, d, "embeddings"), "vec_id", "embedding")
    few = similarity.top_k(similarity.both_ways(p), 4)
    return cut(few.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.col("d").alias("w")).distinct())


@query("spanning_forest")
def q_mst(s, d):
    return graph.minimum_forest(_near(s, d)).select("a", "b", R("w", 5).alias("w"))


@query("tree_clusters")
def q_tree(s, d):
    return cluster.tree_clusters(_near(s, d), table(s, d, "embeddings").select(F.col("vec_id").alias("id")))


_NE = "e as (select least(o_custkey % 40, o_orderkey % 40) as a, greatest(o_custkey % 40, o_orderkey % 40) as b, count(*)::double as w from orders where o_custkey % 40 <> o_orderkey % 40 group by 1, 2), p as (select range as id, range % 4 as cluster from range(40)), bb as (select a, b, w from e union all select b, a, w from e), j as (select pa.cluster as ca, pb.cluster as cb, w from bb join p pa on a = pa.id join p pb on b = pb.id), c as (select ca as cluster, sum(w) as volume, sum(case when ca <> cb then w else 0 end) as cut from j group by 1)"


def _net(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x, y = F.col("o_custkey") % 40, F.col("o_orderkey") % 40
    e = table(s, d, "orders").filter(x != y).groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return e, s.range(40).select("id", (F.col("id") % 4).alias("cluster"))


@query("cut_values", f"with {_NE} select c.cluster, 10::bigint as size, volume, volume - cut as inside, cut, cut / 2 as mincut, cut / 20 as ratio, round(cut / volume / 2, 6) as norm from c")
def q_cut(s, d):
    x = cluster.cut_values(*_net(s, d))
    return x.withColumn("norm", R("norm"))


@query("conductance", f"with {_NE}, s as (select k.cluster, sum(case when pa.cluster = k.cluster and pb.cluster = k.cluster then 2 * w else 0 end) as inside, sum(case when pa.cluster <> k.cluster and pb.cluster <> k.cluster then 2 * w else 0 end) as outside, sum(case when (pa.cluster = k.cluster) <> (pb.cluster = k.cluster) then w else 0 end) as cut from e join p pa on e.a = pa.id join p pb on e.b = pb.id, (select distinct cluster from p) k group by 1) select cluster, round(2 * (0.5 * cut) / (case when least(inside, outside) > 0 then least(inside, outside) else greatest(inside, outside) end), 6) as conductance from s")
def q_cond(s, d):
    return cluster.conductance(*_net(s, d)).select("cluster", R("conductance").alias("conductance"))


@query("closeness", f"""with {_NE}, g as (select a, b, w from e union all select b, a, w from e), x as (select pa.cluster as ca, pb.cluster as cb, w from g join p pa on g.a = pa.id join p pb on g.b = pb.id),
n as (select cluster as k, count(*) as size from p group by 1), m as (select ca as k, count(*) as entries, 0.5 * sum(case when ca <> cb then w else 0 end) as ec from x group by 1), s as (select * from n join m using (k)),
cc as (select ca as i, cb as j, 0.5 * sum(w) as mec, count(*) as num from x where ca < cb group by 1, 2)
select i, j, round(2.0 * mec / (si.ec + sj.ec) * (mec / num) / (si.size::double / (si.size + sj.size) * si.ec / si.entries + sj.size::double / (si.size + sj.size) * sj.ec / sj.entries), 6) as score from cc join s si on i = si.k join s sj on j = sj.k""")
def q_close(s, d):
    return cluster.closeness(*_net(s, d)).select("i", "j", R("score").alias("score"))


# --- graph ----------------------------------------------------------------------

_F = "f as (select distinct s, p, o, o_lang, o_is_literal from triples where s is not null and o is not null)"
_LB = "lb as (select distinct s as id, o as label from triples where p = 'lb' and s is not null and o is not null)"


@query("graph_facts", f"with {_F} select * from f")
def q_facts(s, d):
    return graph.facts(table(s, d, "triples"))


@query("ids_by_label", "select distinct s as id from triples where p in ('lb', 'pt') and regexp_matches(o, '(?i)OID ') and s is not null")
def q_ids(s, d):
    return graph.ids_by_label(table(s, d, "triples"), "OID ", ["lb", "pt"])


@query("labels_of", "select distinct s as id, o as label from triples where p in ('lb', 'pt') and lower(o_lang) = 'en' and s in (select node_id from concepts)")
def q_labels(s, d):
    ids = table(s, d, "concepts").select(F.col("node_id").alias("id"))
    return graph.labels_of(table(s, d, "triples"), ids, ["lb", "pt"], "en")


@query("references", "select distinct s as id, o as ref from triples where p = 'ref' and s is not null and o is not null")
def q_refs(s, d):
    return graph.references(table(s, d, "triples"), ["ref"])


@query("predicates", "select distinct p from triples where s in (select s from triples where p = 'lb')")
def q_prds(s, d):
    return graph.predicates(table(s, d, "triples"), ["lb"])


@query("objects", f"with {_F}, {_LB} select distinct f.s as id, a.label, f.p, f.o as object, b.label as object_label from f join lb a on f.s = a.id join lb b on f.o = b.id where f.p in ('rc', 'co')")
def q_objs(s, d):
    return graph.objects(table(s, d, "triples"), ["rc", "co"], ["lb"])


@query("annotation_values")
def q_annv(s, d):
    """The values of the predicate that carries the label 'reference' here."""
    t = table(s, d, "triples").select("s", "p", "o", "o_lang", "o_is_literal")
    named = s.createDataFrame([("ref", "lb", "reference", None, True)], t.schema)
    return graph.annotation_values(t.unionByName(named), "reference", ["lb"])


_UN = "u0 as (select s as a, o as b from triples where p in ('rc', 'co') and s is not null and o is not null and s <> o), u as (select a, b from u0 union select b, a from u0)"


@query("similar_terms", f"with {_LB}, {_UN} select distinct x.label, y.label as similar from lb x join u on x.id = u.a join lb y on y.id = u.b")
def q_similar(s, d):
    return graph.similar_terms(table(s, d, "triples"), ["lb"], ["rc", "co"])


def _seeds(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "concepts").filter("onto = 'VPH'").select(F.col("node_id").alias("id")).distinct()


@query("closure_among", f"with recursive {_UN}, v as (select distinct node_id as id from concepts where onto = 'VPH'), r(src, dst, d) as (select id, id, 0 from v union select src, b, d + 1 from r join u on u.a = r.dst where d < 3), m as (select src, dst, min(d) as d from r group by 1, 2) select src as i, dst as j, d from m where src < dst and dst in (select id from v)")
def q_closure(s, d):
    e = cut(graph.undirected(table(s, d, "triples"), ["rc", "co"]))
    return graph.closure_among(e, _seeds(s, d), 3)


@query("closure_discovered", f"with recursive {_UN}, v as (select distinct node_id as id from concepts where onto = 'VPH'), r(src, dst, d) as (select id, id, 0 from v union select src, b, d + 1 from r join u on u.a = r.dst where d < 2) select src, dst, min(d) as d from r group by 1, 2 having min(d) >= 1")
def q_closured(s, d):
    e = cut(graph.undirected(table(s, d, "triples"), ["rc", "co"]))
    return graph.closure_with_discovered(e, _seeds(s, d), 1, 2)


@query("neighbours_outside", f"with {_UN}, v as (select node_id as id from concepts where onto = 'VPH') select distinct b as id from u where a in (select id from v) and b not in (select id from v)")
def q_outside(s, d):
    return graph.neighbours_outside(graph.undirected(table(s, d, "triples"), ["rc", "co"]), _seeds(s, d))


@query("components")
def q_comp(s, d):
    return graph.components(graph.undirected(table(s, d, "triples"), ["rc", "co"]))


@query("heap_order")
def q_heap(s, d):
    return graph.heap_order(table(s, d, "nation").select(F.col("n_nationkey").alias("idx")))


# --- annotations ----------------------------------------------------------------


def _dictionary(s: SparkSession, d: str) -> DataFrame:
    """(id, term): every label of every concept, whole."""
    return table(s, d, "concepts").filter("lb is not null and trim(lb) <> ''").select(F.col("node_id").alias("id"), F.trim("lb").alias("term")).distinct()


@query("dictionary_match")
def q_dict(s, d):
    """Places of labels in documents and in literals, which have no key."""
    lit = table(s, d, "triples").filter("o_is_literal").select(F.monotonically_increasing_id().alias("k"), "o")
    t, cols = _dictionary(s, d), ("id", "start", "end", "text")
    in_docs = annotate.match_dictionary(docs(s, d), "doc_id", "text", t).select(F.lit("documents").alias("tbl"), "doc", *cols)
    return in_docs.unionByName(annotate.match_dictionary(lit, "k", "o", t).select(F.lit("triples").alias("tbl"), F.lit(None).cast("bigint").alias("doc"), *cols))


def _annots(s: SparkSession, d: str) -> DataFrame:
    """The tokens' places of three or more characters as annotations of documents."""
    t = annotate.spans_of_tokens(docs(s, d), "doc_id", "text")
    return t.filter(F.length("str") >= 3).select("doc", F.col("i").alias("annot"), (F.col("start") + 1).alias("start"), (F.col("end") + 3).alias("end"))


@query("annotation_alignment")
def q_align(s, d):
    return annotate.align(_annots(s, d), annotate.spans_of_tokens(docs(s, d), "doc_id", "text")).select("doc", "annot", "i")


@query("overlapping_spans", "with p as (select row_no as doc, unnest(passages) as x from bioc_docs), a as (select doc, unnest(x.annotations) as a, x.offset as po from p), l as (select doc, unnest(a.locations) as l from a), q as (select distinct doc, l.offset as s, l.offset + l.length as e from l) select x.doc, x.s as s1, x.e as e1, y.s as s2, y.e as e2 from q x join q y on x.doc = y.doc and y.e > x.s and y.s < x.e and (x.s, x.e) < (y.s, y.e)")
def q_over2(s, d):
    b = table(s, d, "bioc_docs").select(F.col("row_no").alias("doc"), F.explode("passages").alias("x"))
    loc = b.select("doc", F.explode("x.annotations").alias("a")).select("doc", F.explode("a.locations").alias("l")).select("doc", F.col("l.offset").alias("start"), (F.col("l.offset") + F.col("l.length")).alias("end")).dropna().distinct()
    loc = loc.withColumn("id", F.struct("start", "end"))
    o = annotate.overlapping(loc, loc).filter("a < b")
    return o.select("doc", F.col("a.start").alias("s1"), F.col("a.end").alias("e1"), F.col("b.start").alias("s2"), F.col("b.end").alias("e2"))


@query("rebased_spans", "with t as (select row_no as grp, unnest(passages) as x, generate_subscripts(passages, 1) - 1 as i from bioc_docs), n as (select grp, i, coalesce(length(x.text), 0) as n from t), b as (select grp, i, coalesce(sum(n + 1) over (partition by grp order by i rows between unbounded preceding and 1 preceding), 0) as lo, n from n), a as (select grp, i * 1000 as annot, (lo + floor(n / 2))::bigint as s from b where n > 1) select a.grp, (select max(b.i) from b where b.grp = a.grp and b.lo <= a.s) as i, a.annot, a.s - (select max(b.lo) from b where b.grp = a.grp and b.lo <= a.s) as start from a")
def q_rebase(s, d):
    t = table(s, d, "bioc_docs").select(F.col("row_no").alias("grp"), F.posexplode("passages").alias("i", "x")).select("grp", F.col("i").cast("bigint").alias("i"), F.coalesce(F.length("x.text"), F.lit(0)).alias("n"))
    w = Window.partitionBy("grp").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    b = t.withColumn("lo", F.coalesce(F.sum(F.col("n") + 1).over(w), F.lit(0)))
    a = b.filter("n > 1").select("grp", (F.col("i") * 1000).alias("annot"), (F.col("lo") + F.floor(F.col("n") / 2)).alias("start")).withColumn("end", F.col("start") + 1)
    return annotate.rebase(t, a).select("grp", "i", "annot", "start")


@query("left_modifiers", None)
def q_mod(s, d):
    t = annotate.spans_of_tokens(docs(s, d), "doc_id", "text")
    a = t.filter(F.length("str") > 8).select("doc", F.col("i").alias("annot"), "start")
    return annotate.left_modifier(a, t)


# --- payloads and sources -------------------------------------------------------


@query("event_payloads", "select event_id, (props->>'k')::bigint as k from events")
def q_props(s, d):
    return table(s, d, "events").select("event_id", payloads.json_path(F.col("props"), "$.k", "bigint").alias("k"))


@query("unseen_ids", "select distinct pmid::varchar as pmid from documents where pmid is not null and pmid not in (select pmid from bioc_docs where pmid is not null)")
def q_unseen(s, d):
    return payloads.unseen(docs(s, d), table(s, d, "bioc_docs").filter("pmid is not null"), "pmid")


@query("in_input_order", "select d.doc_id, b.n from documents d left join (select pmid, max(len(passages)) as n from bioc_docs group by 1) b using (pmid)")
def q_order(s, d):
    b = table(s, d, "bioc_docs").groupBy("pmid").agg(F.max(F.when(F.col("passages").isNotNull(), F.size("passages"))).alias("n"))
    return payloads.in_input_order(docs(s, d).select("doc_id", "pmid"), b, "pmid").select("doc_id", F.col("n").cast("bigint").alias("n"))


@query("repaired_json")
def q_repair(s, d):
    x = table(s, d, "omim_responses").select("response_id", readers.repair_json(F.col("omim")).alias("v"))
    return x.select("response_id", F.try_parse_json("v").isNotNull().alias("ok"))


@query("approved_symbols", "with c as (select distinct split_part(lb, ' ', 1) as a from concepts where lb is not null) select distinct c.a as asked, t.s as symbol, t.p as kind from c join triples t on lower(c.a) = lower(split_part(t.o, ' ', 1)) where t.p in ('lb', 'tm') and t.s is not null")
def q_sym(s, d):
    t = table(s, d, "triples").filter("s is not null").select(F.element_at(F.split("o", " "), 1).alias("name"), F.col("s").alias("symbol"), F.col("p").alias("kind"))
    return payloads.approved_symbols(table(s, d, "concepts").filter("lb is not null").select(F.element_at(F.split("lb", " "), 1).alias("asked")).distinct(), t, ["lb", "tm"])


@query("porter_stems")
def q_stem(s, d):
    from annotara.functions import stem

    return docs(s, d).select("doc_id", F.array_join(stem.porter_stems(T.tokens(F.coalesce("text", F.lit("")))), " ").alias("v"))


@query("pattern_stems", f"select doc_id, array_to_string(list_transform({TOK}, lambda w: case when length(w) >= 4 then regexp_replace(w, '(?:ing|s|e|able)$', '') else w end), ' ') as v from documents")
def q_pstem(s, d):
    from annotara.functions import stem

    return docs(s, d).select("doc_id", F.array_join(stem.pattern_stems(T.tokens(F.col("text"))), " ").alias("v"))


@query("word_vectors")
def q_w2v(s, d):
    from annotara.operators import models

    return models.word_vectors(docs(s, d), "text", size=20).select("word", F.size("v").alias("n"))


@query("topics")
def q_lda(s, d):
    from annotara.operators import models

    return models.topics(docs(s, d), "doc_id", "text", k=4).select("doc", "cluster", R("u", 3).alias("u"))


@query("principal")
def q_pca(s, d):
    from annotara.operators import models

    return models.principal(table(s, d, "embeddings"), "vec_id", "embedding", 2).select("id", R(F.abs(F.col("v")[0]), 4).alias("x"))


# --- trees of the fact tables, sessions -------------------------------------------


@query("place_tree")
def q_places(s, d):
    n = table(s, d, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("node"), F.concat(F.lit("R:"), "n_regionkey").alias("up"))
    c = table(s, d, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("node"), F.concat(F.lit("N:"), "c_nationkey").alias("up"))
    return hierarchy.solve(hierarchy.links(n.unionByName(c), "node", {"place": "up"})).select("node", "root", "depth")


@query("sessions", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minutes then 1 else 0 end as g from events where user_id is not null), s as (select user_id, ts, sum(g) over (partition by user_id order by ts rows unbounded preceding) as n from g) select user_id, min(ts) as started, count(*) as n from s group by user_id, s.n")
def q_sessions(s, d):
    x = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).filter("user_id is not null")
    w = x.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")


# --- trees, matrices, summaries ---------------------------------------------------


@query("tree_preorder", "select 'R:' || r_regionkey as root, 'R:' || r_regionkey as node, 0::bigint as depth from region where r_regionkey in (select n_regionkey from nation) union all select 'R:' || n_regionkey, 'N:' || n_nationkey, 1 from nation where n_nationkey is not null union all select 'R:' || n_regionkey, 'C:' || c_custkey, 2 from customer join nation on c_nationkey = n_nationkey")
def q_pre(s, d):
    n = table(s, d, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("node"), F.concat(F.lit("R:"), "n_regionkey").alias("parent"))
    c = table(s, d, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("node"), F.concat(F.lit("N:"), "c_nationkey").alias("parent"))
    return trees.preorder(n.unionByName(c)).select("root", "node", "depth")


@query("tree_search", "select 'R:' || n_regionkey as root, 'N:' || n_nationkey as node from nation where n_nationkey % 10 = 7 union all select 'R:' || n_regionkey, 'C:' || c_custkey from customer join nation on c_nationkey = n_nationkey where c_custkey % 10 = 7 and n_nationkey % 10 <> 7")
def q_search(s, d):
    n = table(s, d, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("node"), F.concat(F.lit("R:"), "n_regionkey").alias("parent"))
    c = table(s, d, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("node"), F.concat(F.lit("N:"), "c_nationkey").alias("parent"))
    return trees.search(trees.preorder(n.unionByName(c)), F.col("node").rlike("^[NC].*7$"), stop_found=True)


@query("tree_from_children", "select 'r' || r_regionkey as parent, n_nationkey as node, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int as nth from nation join region on n_regionkey = r_regionkey")
def q_kids(s, d):
    n = table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("kids"))
    return trees.from_children(n.select(F.concat(F.lit("r"), "n_regionkey").alias("id"), "kids"), "id", "kids").select("parent", "node", "nth")


@query("tree_merge_pairs")
def q_merge(s, d):
    return trees.merge_pairs(table(s, d, "supplier"), "s_suppkey")


@query("batches", "select s_suppkey, ((row_number() over (order by s_suppkey) - 1) // 32)::bigint as batch from supplier")
def q_batch(s, d):
    return trees.batches(table(s, d, "supplier"), "s_suppkey", 32).select("s_suppkey", "batch")


@query("count_matrix", f"with {TF} select doc, max(case when term = 'protein' then 1 else 0 end) as protein, max(case when term = 'and' then 1 else 0 end) as \"and\" from tf where term in ('protein', 'and') group by 1")
def q_mat(s, d):
    return features.count_matrix(counts(s, d), ["protein", "and"])


@query("weight_summary", "with w as (select l_linestatus as fold, l_shipdate::date::varchar as feat, sum(l_quantity) as w from lineitem group by 1, 2), x as (select feat, coalesce((w - min(w) over (partition by fold)) / nullif(max(w) over (partition by fold) - min(w) over (partition by fold), 0), 0) as s from w) select feat, round(avg(s), 6) as mean, round(stddev_pop(s), 6) as std from x group by 1")
def q_wsum(s, d):
    w = table(s, d, "lineitem").groupBy(F.col("l_linestatus").alias("fold"), F.col("l_shipdate").cast("date").cast("string").alias("feat")).agg(F.sum("l_quantity").alias("w"))
    return features.weight_summary(w).select("feat", R("mean").alias("mean"), R("std").alias("std"))


@query("analyzed_tokens")
def q_ana(s, d):
    from annotara.functions import stem

    t = features.analyzed(T.tokens(F.coalesce("text", F.lit(""))), [stem.pattern_stems], keep_orig=True)
    return docs(s, d).select("doc_id", F.array_join(t, " ").alias("v"))


@query("enriched_texts")
def q_enr(s, d):
    toks = features.token_rows(docs(s, d), "doc_id", "text")
    w = table(s, d, "w2v_cache").filter("word is not null").select(F.lower("word").alias("term"), (F.col("idx") % 3).cast("int").alias("rank"), F.concat("word", F.lit("_near")).alias("word")).dropDuplicates(["term"])
    return features.enriched(toks, w)


@query("silhouette", f"with p as (select a.vec_id as i, b.label as k, avg(sqrt({_D2})) as m from embeddings a join embeddings b on a.vec_id <> b.vec_id group by 1, 2), x as (select i, max(case when k = label then m end) as a, min(case when k <> label then m end) as b from p join embeddings on vec_id = i group by 1) select i as id, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 5) as s from x")
def q_sil(s, d):
    x = table(s, d, "embeddings")
    p = similarity.both_ways(similarity.pair_distances(x, "vec_id", "embedding"))
    return metrics.silhouette(p, x.select(F.col("vec_id").alias("id"), "label")).select("id", R("s", 5).alias("s"))


@query("precision_at", "with r as (select o_custkey as query, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank, case when o_orderstatus = 'F' then 1 else 0 end as relevant from orders), t as (select query, sum(relevant)::double as r from r group by 1), h as (select query, k, sum(relevant)::double as h from r, (select unnest([1, 3, 5]) as k) where rank <= k group by 1, 2) select k, round(avg(h / k), 6) as precision, round(avg(coalesce(h / nullif(r, 0), 0)), 6) as recall from h join t using (query) group by 1")
def q_pat(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = table(s, d, "orders").select(F.col("o_custkey").alias("query"), F.row_number().over(w).alias("rank"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("relevant"))
    p = metrics.precision_at(r, [1, 3, 5])
    return p.select("k", R("precision").alias("precision"), R("recall").alias("recall"))


@query("series_fields", "select row_no, coalesce(title, '') as title, coalesce(array_to_string(keywords, ';;'), '') as keywords from geo_series")
def q_fields(s, d):
    x = table(s, d, "geo_series").withColumn("fields", F.create_map(F.lit("title"), F.array("title"), F.lit("keywords"), F.coalesce("keywords", F.array().cast("array<string>")), F.lit("row"), F.array(F.col("row_no").cast("string"))))
    return readers.renamed(x, {"row": "row_no", "title": "title", "keywords": "keywords"}).withColumn("row_no", F.col("row_no").cast("bigint"))


@query("uncached_texts", "with k as (select distinct md5(coalesce(text, '')) as m from documents where doc_id % 2 = 0) select md5(coalesce(text, '')) as md5 from documents where md5(coalesce(text, '')) not in (select m from k) group by 1")
def q_cached(s, d):
    x = docs(s, d)
    cache = x.filter(F.pmod("doc_id", F.lit(2)) == 0).select(F.md5(F.coalesce("text", F.lit(""))).alias("md5"), F.lit("answer").alias("answer"))
    return payloads.cached(x.select("doc_id", "text"), "text", cache)[1].select("md5")


SQL.update(oracles.SQL)
