import random

import numpy as np
import pytest

from annotara.llm import sentences as S


def parts(text):
    return [text[a:b] for a, b in S.units(text)]


@pytest.mark.parametrize(
    "units",
    [
        ["Dr. Foo et al. (2003) saw 3.5 mg, e.g. in blood.", "Next one!", "mRNA of X rose."],
        ["All 27 donors lived in the U.S.", "No link was seen."],
        ["The U.S. arm stopped at 5 p.m. on day 3.", "They were kept for approx. 3.4 h.", "Then."],
        ["The panel asked, “Is it safe? Should we stop?” and then voted.", "“It rose. It fell.”", "It ended.[12,14]", "Version 2."],
        ['"We saw no effect. The dose was raised," wrote Foo.', "(A note in brackets. It ends.)", "Go on."],
        ["Am 6. März 2006 begann es.", "Er schrieb: „Keine Wirkung. Wir brachen ab.“, und ging.", "Gemessen z. B. am 3. Tag."],
        ["M. Foo a déclaré : « Aucun effet. Rien. », puis partit.", "Vraiment ?", "Oui !"],
        ["¿Es segura?", "El Dr. Foo dijo: «¿Ya? ¿No?», y anotó.", "¡Nadie!"],
        ["Среднее, т. е. 4,88 мг/кг, дано на рис. 2.", "Опыт начат в 2021 г. в клинике.", "Измеряли A, B и т. д.", "Всё."],
        ["报告写道：「没有效果。剂量加倍。」并列出三项。", "「水平升高。」", "平均为3.5毫克（见图2。），高于对照。"],
        ["「効果なし。増量する。」と書いた。", "上昇した。"],
        ["안전한가?", 'Foo 박사는 "안전한가? 중단할까?"라고 묻고 적었다.', "끝났다."],
        ["क्या यह ठीक है?", "औसत 8.5 मि.ग्रा. (चित्र 3. देखें) था।", "डॉ. Foo ने कहा।"],
        ["سأل د. Foo: «هل هو آمن؟ هل نتوقف؟» ثم سجل.", "هل يؤثر؟", "نعم."],
    ],
)
def test_languages(units):
    assert parts(" ".join(units)) == units


def test_thai_headings_lists_and_lines():
    thai = ["ยังไม่ทราบสาเหตุในMH764029", "แพทย์ถามว่า “ปลอดภัยหรือไม่ ควรหยุดหรือไม่” เมื่อให้A7D", "ค่าเฉลี่ยคือ32.48มก.ซึ่งต่ำกว่า"]
    assert parts(" ".join(thai)) == thai
    text = "Study design\nCells were lysed in\na buffer. It rose.\n\nResults:\n- one item\n- two items\n1) three\nAIM: We studied it."
    assert parts(text) == ["Study design", "Cells were lysed in\na buffer.", "It rose.", "Results:", "- one item", "- two items", "1) three", "AIM: We studied it."]
    assert parts("It stopped.Then it rose. See http://a.example/x.html for more.") == ["It stopped.", "Then it rose.", "See http://a.example/x.html for more."]


def test_units_leave_out_white_space_only():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice('aB .!?"“”«»()[]\n\t。」「1é…') for _ in range(rng.randrange(60)))
        u = S.units(t)
        at = 0
        for a, b in u:
            assert a >= at and a < b and not t[a].isspace() and not t[b - 1].isspace() and not t[at:a].strip()
            at = b
        assert not t[at:].strip()


def _walk(marks, step, out):
    state, res = 0, []
    for m in marks:
        res.append(int(out[m, state]))
        state = step[m, state]
    return res


def test_chunks_compose_like_one_walk():
    rng = random.Random(6)
    for step, out in ((S.STEP, S.OUT), (S.LINE_STEP, S.LINE_OUT)):
        marks = np.array([rng.randrange(len(step)) for _ in range(3000)])
        for chunk in (5000, 64, 7, 1):
            assert S.scan(marks, step, out, chunk).tolist() == _walk(marks, step, out)


def test_every_document_goes_through_the_scan(monkeypatch):
    seen, scan = [], S.scan
    monkeypatch.setattr(S, "scan", lambda m, s, o, chunk=S.CHUNK: (seen.append((len(s), -(-len(m) // chunk))), scan(m, s, o, chunk))[1])
    texts = ["One. Two.", "", "A (b. c) word. Every."] * 100
    got = S.units_of(texts)
    assert [len(x) for x in got[:3]] == [2, 0, 2] and got == [S._spans(t, [b for _, b in g]) for t, g in zip(texts, got)]
    assert [x for x, _ in seen] == [len(S.LINE_STEP), len(S.STEP)] and all(c > 1 for _, c in seen)


def test_rules_are_rows_of_the_table():
    for word, before, nxt, how in (("plain", "lower", "upper+", "G"), ("never", "lower", "upper+", "G"), ("maybe", "lower", "lower", "G"), ("plain", "digit", "digit", "T")):
        m = S.stop_mark(S.WORDS.index(word), S.BEFORES.index(before), S.NEXTS.index(nxt), S.HOWS.index(how))
        assert S.OUT[m, 1] == S.stop_ends(word, before, nxt, how) and not S.OUT[m, 2:].any()


def test_long_and_deep_brackets():
    for inner in ("It rose. ", "Then it fell again. "):
        quoted = "He wrote: “" + inner * 600 + "It ended.”"
        assert parts(quoted + " Next one.") == [quoted, "Next one."]
    assert parts("Cells (first (second (third group) was lysed) were kept. They rose) in buffer. Next.") == ["Cells (first (second (third group) was lysed) were kept. They rose) in buffer.", "Next."]
    assert parts("a (b. " * 7 + "c" + " d.)" * 7 + ". E.") == ["a (b. " * 7 + "c" + " d.)" * 7 + ".", "E."]
    item = "- " + "long item without an end " * 20
    assert parts(item.strip() + "\n- two") == [item.strip(), "- two"]


def test_stops_of_more_scripts():
    assert parts("Gov. Foo and Rev. Bar met Sgt. Baz. They left.") == ["Gov. Foo and Rev. Bar met Sgt. Baz.", "They left."]
    assert parts("Ինչ է։ Այո։") == ["Ինչ է։", "Այո։"] and parts("ការ។ ខែ។") == ["ការ។", "ខែ។"] and parts("စာ။ နေ။") == ["စာ။", "နေ။"]



def test_empty_long_and_garbled(spark):
    one = "He said “no. Never.” and left. "
    rows = [(1, None), (2, ""), (3, " \n"), (4, one * 20000), (5, "Ã‰ seguro? NÃ£o. Fim."), (5, "A. b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, k string")
    got = S.split(df, "doc_id", "text").collect()
    assert {r.doc_id for r in got} == {4, 5}
    assert sum(r.doc_id == 4 for r in got) == 20000
    t = rows[4][1]
    assert [t[r.sent_start : r.sent_end] for r in got if r.doc_id == 5][:3] == ["Ã‰ seguro?", "NÃ£o.", "Fim."]
    assert S.split(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize(("a", "b"), [("(", ")"), ("“", "”"), ('"', '"'), ("„", "“")])
def test_long_quotations_and_list_items_are_whole(a, b):
    inside = "It rose. It fell. " * 150
    text = f"Foo said {a}{inside.strip()}{b}, and left."
    assert parts(text + " Then.") == [text, "Then."]
    item = "- " + "one item of many words, " * 12 + "and more"
    assert parts(f"Results:\n{item}\n{item}") == ["Results:", item, item]
