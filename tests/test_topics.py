from pyspark.ml.feature import CountVectorizer

import __spark_entry__ as entry
from annotara.functions import text as T
from annotara.session import table


def test_no_term_is_dropped(spark, data, monkeypatch):
    """topics hands CountVectorizer a size that holds every term there is."""
    sizes, fit = [], CountVectorizer.fit
    monkeypatch.setattr(CountVectorizer, "fit", lambda self, d: (lambda m: sizes.append(len(m.vocabulary)) or m)(fit(self, d)))
    rows = entry.queries()["topics"](spark, data).collect()
    docs = table(spark, data, "documents")
    terms = docs.selectExpr("explode(regexp_extract_all(lower(coalesce(text, '')), '" + T.TOKEN.replace("\\", "\\\\") + "', 0))").distinct().count()
    assert sizes == [terms] and terms > 1000
    assert len(rows) == 4 * docs.count()
