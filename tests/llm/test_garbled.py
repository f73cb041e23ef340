import pytest

from annotara.llm import garbled as G

TEXTS = {
    "fr": "L’expression a été mesurée à l’œil nu — « déjà » élevée.",
    "de": "Größere Mengen störten die Bindung während der Nachsorge.",
    "ru": "Действует ли препарат на рецептор в культуре клеток? Связь не выявлена.",
    "ja": "老齢マウスにおける抗体は測定できなかった。",
    "zh": "医生问：“安全吗？要停药吗？”随后记录了结果。",
    "th": "ยังไม่ทราบสาเหตุของการสูญเสียในหนูสูงอายุ",
    "ar": "لم نجد علاقة بين العلاج والمرض في نخاع العظم",
}


@pytest.mark.parametrize("lang", TEXTS)
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252"])
def test_utf8_read_as_one_byte(lang, wrong):
    t = TEXTS[lang]
    back = {b: c for c, b in G.SINGLE[wrong].items()}
    bad = "".join(chr(b) if b < 128 else back[b] for b in t.encode())
    assert G.repair(bad) == (t, True)
    mixed = f"Clean part first. {bad} And a clean end."
    assert G.repair(mixed) == (f"Clean part first. {t} And a clean end.", True)


@pytest.mark.parametrize(("lang", "meant", "wrong"), [("ru", "cp1251", "latin-1"), ("ru", "koi8-r", "cp1251"), ("ja", "cp932", "latin-1"), ("ja", "euc_jp", "latin-1"), ("zh", "gbk", "latin-1"), ("th", "cp874", "latin-1"), ("de", "utf-8", "cp437"), ("fr", "utf-8", "mac_roman")])
def test_other_pairs_are_found(lang, meant, wrong):
    bad = TEXTS[lang].encode(meant).decode(wrong)
    now, hit = G.repair(bad)
    assert hit and now != bad


def test_nested_layers_and_places():
    t = "Größe é"
    bad = t.encode().decode("cp1252").encode().decode("cp1252")
    now, spans = G.restore(bad)
    assert now == t and len(spans) == len(now)
    assert all(a < b for a, b in spans) and spans[0] == (0, 1) and spans[-1][1] == len(bad)


@pytest.mark.parametrize("lang", TEXTS)
def test_clean_texts_stay(lang):
    assert G.repair(TEXTS[lang]) == (TEXTS[lang], False)


def test_names_signs_and_edges():
    for t in ("Ãtreltarman, Žharfamelo and Daltameloø at 15 °C ± 2 µM", "СССР» и КГБ", "NÃO HOUVE ALTERAÇÃO", "café", "👩‍🔬 🙂", "", None, "plain"):
        assert G.repair(t) == (t, False)
    assert G.repair("lost � bytes")[1]


def test_rows(spark):
    bad = TEXTS["fr"].encode().decode("latin-1")
    rows = [(1, bad), (2, TEXTS["fr"]), (3, None), (4, ""), (5, bad * 2000), (1, bad)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id bigint, text string, k int")
    assert sorted(r.id for r in G.found(df, "id", "text").collect()) == [1, 1, 5]
    assert {r.restored for r in G.restored(df, "id", "text").filter("id = 1").collect()} == {TEXTS["fr"]}
    assert G.found(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize(("t", "wrong"), [("the β-chain", "mac_roman"), ("the γ-chain", "mac_roman"), ("a “word", "cp850"), ("so … on", "cp850")])
def test_one_short_stretch_is_found(t, wrong):
    bad = t.encode().decode(wrong)
    assert any(c[3] >= G.STRONG for c in G._candidates(bad))
    assert G.is_hit(bad) and G.repair(bad) == (t, True)


def test_the_gate_is_no_narrower_than_the_candidates():
    import random

    rng = random.Random(5)
    parts = [*"βγπσµéüßÉñøαΩ±°·“”…—–œ", *"жёЯ", "é“", "ção", "Ñandú", "при", "抗体", "医生", "テスト", "한국", "ลอง", "لم ", "ab", "x", " ", "-", "Yes", "@a"]
    names = ["utf-8", *G.SINGLE, *G.DOUBLE, "euc_jp", "cp874", "cp1256", "iso8859-5"]
    strong = 0
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        bad = rng.choice(["", " ", "in "]) + t.encode(rng.choice(names), "ignore").decode(rng.choice(names), rng.choice(["ignore", "replace"])) + rng.choice(["", " ", "s of"])
        if any(c[3] >= G.STRONG for c in G._candidates(bad)):
            strong += 1
            assert G.suspicious(bad), bad
    assert strong > 400


MORE = {
    "pl": "Zażółć gęślą jaźń, wykonano badania źródła przepływu.",
    "vi": "Chúng tôi đã nghiên cứu hai trăm mẫu từ bệnh nhân.",
    "el": "Η έκφραση του υποδοχέα στα κύτταρα δεν άλλαξε.",
    "uk": "Чи діє препарат на рецептор у культурі клітин?",
}


@pytest.mark.parametrize("lang", MORE)
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "mac_roman"])
def test_other_alphabets_come_back(lang, wrong):
    t = MORE[lang]
    back = {b: c for c, b in G.SINGLE[wrong].items()}
    bad = "".join(chr(b) if b < 128 else back[b] for b in t.encode())
    assert G.repair(t) == (t, False) and G.repair(bad) == (t, True)


@pytest.mark.parametrize(
    ("t", "meant", "wrong"),
    [
        ("A café-au-lait patch and naïve cells", "utf-8", "gbk"),
        ("Doses of 186 mg and 412 mg", "utf-8", "gbk"),
        ("kept at 15 °C for 40 h", "utf-8", "gbk"),
        ("nous avons étudié 259 échantillons", "utf-8", "cp1251"),
        ("Vials from Þlaxtoard cost", "utf-8", "cp1252"),
        ("a “quoted form” of it", "mac_roman", "latin-1"),
        ("Среднее значение дано на рис. 305", None, None),
    ],
)
def test_short_stretches_come_back(t, meant, wrong):
    bad = t.encode(meant).decode(wrong) if meant else t.replace("дано", "äàíî")
    assert bad != t and G.repair(bad) == (t, True)


def test_six_layers():
    t = bad = "Größe é"
    for _ in range(6):
        back = {b: c for c, b in G.SINGLE["cp1252"].items()}
        bad = "".join(chr(b) if b < 128 else back[b] for b in bad.encode())
    assert G.repair(bad) == (t, True)


def test_capitals_of_portuguese_stay():
    for t in ("NÃO HOUVE ALTERAÇÃO DE CPGV-4", "DIZ A SEÇÃO 108.", "版本292.238的转录本目录收录了NCRK以及位ABC和尾巴"):
        assert G.repair(t) == (t, False)
