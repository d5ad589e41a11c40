from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import language_id as li

TEXTS = {
    "en": ["The valve opens when the pressure in the chamber rises above a stored value.", "A further aspect relates to a method wherein the plate is heated and joined.", "The claims are not limited to what is shown in the drawings."],
    "de": ["Das Ventil öffnet, sobald der Druck in der Kammer über einen Wert steigt.", "Ein weiterer Aspekt betrifft ein Verfahren, bei dem die Platte erwärmt wird.", "Die Ansprüche sind nicht auf die Zeichnungen beschränkt."],
    "fr": ["La soupape s'ouvre lorsque la pression dans la chambre dépasse une valeur.", "Un autre aspect concerne un procédé dans lequel la plaque est chauffée.", "Les revendications ne sont pas limitées aux dessins."],
    "es": ["La válvula se abre cuando la presión en la cámara supera un valor.", "Otro aspecto se refiere a un procedimiento en el que la placa se calienta.", "Las reivindicaciones no se limitan a los dibujos."],
    "pt": ["A válvula abre quando a pressão na câmara ultrapassa um valor.", "Outro aspecto refere-se a um processo no qual a placa é aquecida.", "As reivindicações não se limitam aos desenhos."],
    "ru": ["Клапан открывается, когда давление в камере превышает значение.", "Другой аспект относится к способу, при котором пластину нагревают.", "Формула не ограничена чертежами."],
    "zh": ["当腔室内的压力超过阈值时，阀门打开。", "另一方面涉及一种加热板的方法。", "权利要求不限于附图。"],
    "ja": ["室内の圧力が値を超えると、弁が開く。", "別の態様は、板を加熱する方法に関する。", "請求項は図面に限定されない。"],
    "ko": ["챔버의 압력이 값을 초과하면 밸브가 열린다.", "다른 측면은 판을 가열하는 방법에 관한 것이다.", "청구항은 도면에 한정되지 않는다."],
}


@pytest.fixture(scope="module")
def model():
    texts = [(f"{a} {b} {i}", k) for k, v in TEXTS.items() for i, a in enumerate(v) for b in v]
    # A tenth of the labels is wrong.
    labels = [list(TEXTS)[(list(TEXTS).index(k) + 1) % 9] if n % 10 == 0 else k for n, (_, k) in enumerate(texts)]
    return li.fit([t for t, _ in texts], labels, np.ones(2**li.BITS))


def test_held_out_texts(model):
    log_p, weight = model.scores([t for v in TEXTS.values() for t in v])
    assert [li.LANGUAGES[k] for k in log_p.argmax(axis=1)] == [k for k, v in TEXTS.items() for _ in v]
    assert (weight > 0).all() and np.allclose(np.exp(log_p).sum(axis=1), 1)


def test_segments(spark, model):
    en, de = TEXTS["en"], TEXTS["de"]
    rows = [
        ("document", 1, "en", True, "\n\n".join([en[0], en[1], de[0], de[1], en[2] + " " + en[0]])), ("document", 2, "de", True, f"{de[0]}\n\n 12 \n\n{de[1]}"), ("document", 3, None, True, "12 34"),
        ("page", 4, "fr", False, f"{de[0]}\n\n{de[1]}"), ("document", 5, "", True, None), ("document", 6, "en", True, ""), ("document", 7, "en", True, "\n\n" + en[0]), ("document", 8, "ja", True, TEXTS["ja"][0] * 2000),
    ]
    df = spark.createDataFrame(rows, "rec string, rec_id bigint, label string, mixed boolean, text string")
    got = {(r.rec_id, r.seg_no): (r.lang, r.n_segments) for r in li.segments(df, model).collect()}
    assert got == {(1, 0): ("en", 3), (1, 2): ("de", 3), (1, 4): ("en", 3), (2, 0): ("de", 1), (4, 0): ("de", 1), (7, 0): ("en", 1), (8, 0): ("ja", 1)}
    assert all(0 < r.confidence <= 1 for r in li.segments(df, model).collect())


@pytest.mark.parametrize(("label", "lang"), [("EN", "en"), ("en_US", "en"), ("pt-BR", "pt"), ("German", "de"), ("chi_sim", "zh"), ("ch", "zh"), (" fre ", "fr"), ("xx", None), ("", None), (None, None), ("mul", None), ("-", None)])
def test_labels(spark, label, lang):
    assert spark.createDataFrame([(label,)], "x string").select(li.label_language(F.col("x")).alias("y")).first().y == lang


def test_sample_is_bounded(spark):
    rows = [(f"{TEXTS['en'][0]} {i}", "en") for i in range(2000)] + [(f"{TEXTS['de'][0]} {i}", "de") for i in range(40)]
    counts = {r.lang: r["count"] for r in li.training_sample(spark.createDataFrame(rows, "text string, label string"), 100).groupBy("lang").count().collect()}
    assert 50 < counts["en"] < 160 and counts["de"] == 40


def test_document_frequencies(spark):
    texts = ["abc", "abd", "", None, "xyz" * 100]
    idf = li.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    ids, rows = li.grams([t for t in texts if t])
    for feature in np.unique(ids):
        df = len(np.unique(rows[ids == feature]))
        assert idf[feature] == pytest.approx(np.log(4 / (1 + df)) + 0.5)


def test_whole_pipeline(spark):
    def table(schema, rows):
        return spark.createDataFrame(rows, schema)

    docs = [(i * 100 + j, f"{a} {b} {n}\n\n{b}", k) for i, (k, v) in enumerate(TEXTS.items()) for n, a in enumerate(v) for j, b in enumerate(v, 10 * n)]
    docs += [(5000, TEXTS["de"][0] + "\n\n" + TEXTS["de"][1], "fr"), (5001, TEXTS["en"][0] + " " + TEXTS["en"][1] + "\n\n" + TEXTS["ru"][0] + " " + TEXTS["ru"][1], "en")]
    documents = table("doc_id bigint, text string, lang string", docs)
    responses = table("response_id bigint, abstract string, publication_language string, filed_abstract string, filing_language string", [(1, TEXTS["es"][0], None, TEXTS["es"][1], "es-MX")])
    pages = table("page_id bigint, text string, language string", [(1, TEXTS["en"][0] + "\n" + TEXTS["en"][1], "unknown")])
    got = {tuple(r) for r in li.found(responses, pages, documents).collect()}
    assert got == {("document", 5000, 0, "de"), ("document", 5001, 0, "en"), ("document", 5001, 1, "ru"), ("published", 1, 0, "es"), ("page", 1, 0, "en")}
