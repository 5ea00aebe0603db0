"""Wrong encodings: found wherever they occur, restored exactly where no byte was lost, and never in clean text."""

import random

import pytest

from plumbline.llm import garbled as g

CLEAN = [
    "La función {} devuelve una lista nueva y no modifica el parámetro {}.", "Für leere Eingaben löst {} keinen Fehler aus, obwohl {} größer wäre.", "L’équipe a relevé des écarts très gênants dans {} – déjà vus près de {}.",
    "Проверка: значение {} не совпадает с описанием, хотя {} вызывает исключение.", "A função {} não altera a lista {} – ATENÇÃO, é lançada após a conversão.", "関数 {} は新しいリストを返し、引数 {} を変更しません。", "Cost: €4.31 per {}, 37 °C in the test rack of {}.",
]
NAMES = ["alpha", "bravo", "carrier", "delta"]


def texts(rng, n):
    return [" ".join(rng.choice(CLEAN).format(rng.choice(NAMES), rng.choice(NAMES)) for _ in range(rng.randint(2, 5))) for _ in range(n)]


def misread(text, read, wrote="utf-8"):
    back = {b: c for c, b in g._table(read).items() if not "\x80" <= c <= "\x9f"} | {}
    return "".join(chr(b) if b < 0x80 else back.get(b, chr(b)) for b in text.encode(wrote))


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850"])
def test_sequences_restore_what_was_read_wrong(read):
    mapping = g.Mapping([read], {c: 9 for t in CLEAN for c in t})
    for t in CLEAN:
        wrong = misread(t, read)
        if wrong == t:
            continue
        spans = mapping.stretches(wrong)
        assert spans
        out, at = "", 0
        for a, b, now in spans:
            out, at = out + wrong[at:a] + now, b
        assert out + wrong[at:] == t
        assert mapping.stretches(t) == []


def test_transformations_are_inferred_from_twins():
    t = CLEAN[0]
    assert ("mac_roman", "utf-8") in {(r, w) for r, w, _, _ in g.infer(misread(t, "mac_roman"), t)}
    assert ("cp1252", "utf-8") in {(r, w) for r, w, _, _ in g.infer(misread(misread(t, "cp1252"), "cp1252"), t)}
    assert ("cp1251", "koi8-r") in {(r, w) for r, w, _, _ in g.infer(CLEAN[3].encode("koi8-r").decode("cp1251"), CLEAN[3])}
    assert g.align("a é b", "a b é") == [] and g.infer(t, t) == []


def test_half_sequences():
    mapping = g.Mapping(["cp1252", "latin-1"], {c: 9 for t in CLEAN for c in t})
    dropped = "".join(c for c in misread(CLEAN[5], "latin-1") if not "\x80" <= c <= "\x9f")
    assert mapping.stretches(dropped)
    for t in CLEAN + ["«é» ou «è»", "1º e 2ª são", "NÃO É SEGURA: ATENÇÃO", "¿Qué? ¡Sí!", "37 °C, 5 µs, ±2"]:
        assert mapping.stretches(t) == []


def test_table(spark):
    rng = random.Random(4)
    rows, wrong = [], set()
    for i, t in enumerate(texts(rng, 400)):
        kind = i % 20
        bad = t
        if kind == 0:
            bad = misread(t, "cp1252")
        elif kind == 1:
            bad = misread(t, "latin-1")
        elif kind == 2:
            bad = misread(misread(t, "cp1252"), "cp1252")
        elif kind == 3:
            bad = t.replace("é", "�").replace("ö", "�").replace("и", "�")
        elif kind == 4 and "Проверка" in t:
            parts = t.split(" ")
            bad = " ".join(p.encode("koi8-r").decode("cp1251") if g._RUN.search(p) and "А" <= p[0] <= "я" else p for p in parts)
        rows.append((i, bad))
        if bad != t:
            wrong.add(i)
    quoted = [(1000, "Test 7 feeds the literal 'â€™' to the cleaner."), (1001, 'Case 8: input "fÃ¼r" must come out as "für".'), (1002, None), (1003, ""), (1004, "plain"), (1005, "Łódź, Škoda und Åse – 5 µs ≥ 3 × 2"), (1006, "NÃO É SEGURA, À LA CARTE, ÉTÉ")]
    df = spark.createDataFrame(rows + quoted, "doc_id bigint, text string").selectExpr("*", "'x' as words", "1 as key")
    got = {r.doc_id: r for r in g.Garbled(df, "doc_id", "text").restored().collect()}
    assert set(got) == wrong
    clean = dict(enumerate(texts(random.Random(4), 400)))
    exact = [i for i in wrong if i % 20 in (0, 1, 2)]
    assert all(got[i].restored == clean[i] and got[i].n_lost == 0 for i in exact)
    assert g.Garbled(df.limit(0), "doc_id", "text").restored().collect() == []
    huge = spark.createDataFrame([(1, "fÃ¼r alle " * 50_000)] + [(k, "für alle") for k in range(2, 6)] + [(7, "fÃ¼r schÃ¶ne"), (8, "schöne"), (9, "schöne")], "doc_id bigint, text string")
    rest = {r.doc_id: r.restored for r in g.Garbled(huge, "doc_id", "text").restored().collect()}
    assert rest == {1: "für alle " * 50_000, 7: "für schöne"}


VERBS = ["возвращает", "проверяет", "изменяет", "создаёт", "удаляет", "сравнивает", "сохраняет", "читает"]
OBJECTS = ["значение", "параметр", "список", "строку", "описание", "исключение", "документ", "результат", "функцию", "таблицу"]


def russian(rng):
    return f"Функция {rng.choice(VERBS)} {rng.choice(OBJECTS)} и {rng.choice(VERBS)} {rng.choice(OBJECTS)}, если {rng.choice(OBJECTS)} не {rng.choice(VERBS)} {rng.choice(OBJECTS)}."


@pytest.mark.parametrize("read,wrote", [("cp1251", "koi8-r"), ("koi8-r", "cp1251")])
@pytest.mark.parametrize("near", [False, True])
def test_a_garbled_text_in_a_third_of_the_rows(spark, read, wrote, near):
    rng = random.Random(7)
    clean = [(i, russian(rng)) for i in range(120)]
    hot = "Функция проверяет параметр, возвращает значение, сравнивает список, изменяет результат."
    wrong = [(1000 + i, f"{hot} {i}" if near else hot) for i in range(60)]
    garbled = [(i, t.encode(wrote).decode(read)) for i, t in wrong]
    df = spark.createDataFrame(clean + garbled, "doc_id bigint, text string")
    got = {r.doc_id: r.restored for r in g.Garbled(df, "doc_id", "text").restored().collect()}
    assert got == dict(wrong)


def test_a_hot_garbled_sentence_gives_votes(spark):
    clean = [f"Für {n} löst größer keinen Fehler aus" for n in ("alpha", "bravo")]
    rows = [(i, misread(t, "mac_roman") + f". Nr {k}") for k in range(20) for i, t in enumerate(clean)] + [(9, t) for t in clean] + [(10, misread(t, "cp437")) for t in clean]
    votes = {(r.read, r.wrote) for r in g.Garbled(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").votes().filter("votes >= 2").collect()}
    assert {("mac_roman", "utf-8"), ("cp437", "utf-8")} <= votes


def test_half_sequences_need_a_learned_transformation(spark):
    odd = "Ã¤" * 40 + "x"
    df = spark.createDataFrame(list(enumerate([odd, "plain", CLEAN[0], CLEAN[1]])), "doc_id int, text string")
    assert g.Garbled(df, "doc_id", "text").restored().collect() == []
    assert g.Mapping([], {}).stretches(odd) == [] and g.Mapping([], {}).stretches("caf�")
    assert g.Mapping(["latin-1"], {"ä": 9}).stretches(odd)[0][2] == "ä" * 40


def test_long_words_and_sentences_are_learned_from(spark):
    word = "漢字仮名交" * 40  # one run of 200 characters, as Japanese writes
    assert "".join(word[a:b] for a, b in g.tokens(word)) == word and max(b - a for a, b in g.tokens(word)) <= g.WORD_PART
    long = "the größe of every column and the façade of it " * 200
    parts, wrong = g.sentences(long), g.sentences(misread(long, "cp1252"))
    assert {g.skeleton(x) for x in parts} == {g.skeleton(x) for x in wrong} and len(parts) > 1
    rows = [word, word + "。", misread(word, "cp1252"), long, misread(long, "cp1252"), long + "x", *CLEAN, *[misread(t, "cp1252") for t in CLEAN]]
    got = {r.doc_id: r.restored for r in g.Garbled(spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string"), "doc_id", "text").restored().collect()}
    assert got[2] == word and got[4] == long and not {0, 1, 3, 5} & set(got)


@pytest.mark.parametrize("text,inside", [("says 'Ã¤x' here", True), ("says 'Ã¤x here'", False), ("`" + "Ã¤" * 300 + "`", True), ("Ã¤'", False)])
def test_quoted_words_of_any_length(text, inside):
    m = g._RUN.search(text)
    assert g._within(g._quoted(text), *m.span()) == inside
