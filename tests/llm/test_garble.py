import random

import pytest
from pyspark.sql import functions as F

from orrery.llm.garble import CODECS, Model, aligned, dissect, garbled, grown, named, weave

NOUNS = "trésorerie société marché Zürich Łódź São café forêt über łatwo señal qualité".split()
RUSSIAN = "Компания сообщила о выручке за год и прогнозе на следующий квартал после сделки".split()
FILL = "the plant in a report on margins and sales with growth for customers under terms".split()


def clean_text(rnd):
    words = [rnd.choice(NOUNS if rnd.random() < 0.3 else FILL) for _ in range(30)]
    return " ".join(words) + f" № {rnd.randrange(10**6)} “quoted” – {rnd.randrange(10**6)}."


def garble(text, written, read, times=1):
    for _ in range(times):
        text = "".join(c for b in text.encode(written, "replace") for c in [bytes([b]).decode(read, "ignore") or chr(b)])
    return text


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(9)
    rows, true = [], {}
    for i in range(600):
        t = clean_text(rnd) if i % 3 else " ".join(rnd.choice(RUSSIAN) for _ in range(20)) + f" {rnd.randrange(10**6)} and so on and so forth."
        rows.append((i, t))
    for k, (how, twin) in enumerate([(h, w) for h in [("utf-8", "cp1252", 1), ("utf-8", "cp1252", 2), ("utf-8", "mac_roman", 1), ("utf-8", "cp437", 1), ("cp1251", "latin-1", 1), ("koi8-r", "cp1251", 1)] for w in (True, True, True, False)]):
        base = rows[3 * k if how[0] != "utf-8" else 3 * k + 1][1] if twin else (clean_text(rnd) if how[0] == "utf-8" else " ".join(rnd.choice(RUSSIAN) for _ in range(25)) + ".")
        true[1000 + k] = base
        rows.append((1000 + k, garble(base, *how)))
    rows.append((2000, "Only one place: SÃ£o, the rest is fine"))
    true[2000] = "Only one place: São, the rest is fine"
    rows.append((2001, "Some are lost: S�o"))
    true[2001] = "Some are lost: S�o"
    rows += [(3000, "The sign says ‘HORTELÃ’ near"), (3001, "Crates marked CHÂ–5 and LÃ–14"), (3002, "The «JURÂ» brand"), (3003, "Film of 8 Å–625 Å, √62 and ├─"), (3004, ""), (3005, None), (3006, "ПРОДАЖИ В ГОДУ"), (None, "Ã©tÃ©")]
    return rows, true


def test_finds_and_restores(spark, corpus):
    rows, true = corpus
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc long, text string, h string, n int")
    got = {r.id: r for r in garbled(df, ident=F.col("doc"), text=F.col("text"), untaught=True).collect()}
    assert got.keys() == true.keys()
    assert [i for i in true if got[i].restored != true[i]] == []
    assert got[2001].lost and not got[2000].lost
    assert sum(r.by_twin for r in got.values()) >= 12


def test_empty_and_repeated(spark):
    schema = "doc long, text string"
    assert garbled(spark.createDataFrame([], schema), ident=F.col("doc"), text=F.col("text")).count() == 0
    row = (1, "cafÃ© " * 5_000 + "naÃ¯ve café " * 5_000 + "naïve café " * 50_000)
    got = garbled(spark.createDataFrame([row, row], schema), ident=F.col("doc"), text=F.col("text"), untaught=True).collect()
    assert [r.restored for r in got] == [row[1].replace("Ã©", "é").replace("Ã¯", "ï")] * 2


def run(spark, rows, **kw):
    return {r.id: r for r in garbled(spark.createDataFrame(rows, "doc long, text string"), ident=F.col("doc"), text=F.col("text"), **kw).collect()}


def test_copies_of_a_garbled_text_do_not_make_its_characters_unusual(spark):
    rnd = random.Random(1)
    rows = [(i, clean_text(rnd)) for i in range(200)]
    rows += [(300 + i, f"Den gode smørrebrød number {i} is on the menu of the day.") for i in range(10)]
    rows += [(400 + i, garble("One and the same notice about smørrebrød, sent over and over.", "utf-8", "cp1252")) for i in range(60)]
    rows += [(500, garble("Another text that has smørrebrød as well, without a twin.", "utf-8", "cp1252"))]
    assert run(spark, rows, untaught=True).keys() == {*range(400, 460), 500}


def test_what_twins_prove_is_not_refused(spark):
    rnd = random.Random(2)
    rows = [(i, clean_text(rnd)) for i in range(200)]
    rows += [(300 + i, garble(rows[i][1], "utf-8", "cp1252")) for i in range(40)]
    rows += [(400, "The place called Ŵyre has a clean notice of its own here."), (401, garble("The place called Ŵyre has a clean notice of its own here.", "utf-8", "cp1252"))]
    rows += [(410 + i, garble(f"Nobody else writes of Ŵyre, in {i} texts without any twin.", "utf-8", "cp1252")) for i in range(5)]
    assert {401, *range(410, 415)} <= run(spark, rows).keys()


def test_a_clean_twin_brings_a_record_back(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(RUSSIAN) for _ in range(20)) + f" {rnd.randrange(10**6)} and so on and so forth.") for i in range(200)]
    rows += [(300 + i, garble(rows[i][1], "cp1251", "latin-1")) for i in range(20)]
    short = "The only word of the answer was Да and nothing more."
    rows += [(400, short), (401, garble(short, "cp1251", "latin-1"))]
    got = run(spark, rows)
    assert got.keys() == {*range(300, 320), 401}
    assert got[401].restored == short and got[401].by_twin and not got[401].lost and got[401].n_stretches == 1


def test_alignment_tells_what_bytes_were_read_as():
    model = Model({}, {}, {})
    assert aligned("utf-8", ["Ã£", "Ã©"], ["ã", "é"], model) == [("utf-8", [(0xA3, "£"), (0xA9, "©"), (0xC3, "Ã")])]
    assert aligned("utf-8", ["Ã£", "ÃŠ"], ["ã", "ú"], model) == [("utf-8", [(0xA3, "£"), (0xBA, "Š"), (0xC3, "Ã")])]
    assert aligned("utf-8", ["Ã£", "ÅŠ"], ["ã", "ú"], model) == []  # one byte would be two characters
    s = "São é – x"
    assert weave(*dissect(s)) == s and dissect(s) == ("So   x", [1, 3, 4], ["ã", "é", "–"]) and dissect("") == ("", [], [])
    assert CODECS["cp1252"].undo("Ã©", "utf-8") == "é" and CODECS["cp1252"].undo("é", "utf-8") is None and CODECS["cp1252"].undo("日", "utf-8") is None


def test_a_reading_that_no_encoding_has_is_learned(spark):
    """Bytes read by a table of its own: what twins show of it is enough to restore texts without twins."""
    rnd = random.Random(4)
    odd = {b: chr(0x2800 + (b * 37) % 128) for b in range(128, 256)}
    broken = lambda t: "".join(odd.get(b) or chr(b) for b in t.encode())
    rows = [(i, clean_text(rnd)) for i in range(300)]
    rows += [(400 + i, broken(rows[i][1])) for i in range(40)]
    late = {500 + i: clean_text(rnd) for i in range(20)}
    got = run(spark, rows + [(i, broken(t)) for i, t in late.items()])
    assert got.keys() == {*range(400, 440), *late}
    assert all(got[i].restored == t for i, t in late.items()) and all(got[400 + i].restored == rows[i][1] for i in range(40))


def test_tables_are_named_by_the_encodings_that_explain_them():
    told = [(CODECS["cp1252"].own[c], c) for c in "Ã©¨±€™œ"] + [(0x80, "\x80"), (0x99, "\x99"), (0x9C, "\x9c")]
    seen = {(min(a, b), max(a, b)): 3 for a in told for b in told}
    ((seed, table),) = grown(seen)
    assert {t.reading.name for t in named("utf-8", seed, table, 0)} == {"cp1252", "latin-1"}


def test_short_sentences_and_near_twins(spark):
    """Sentences without ASCII letters have twins too, and records that share one sentence only."""
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice("売上高は前年同期比で増加し利益率も改善した会社発表によると") for _ in range(12)) + f". {clean_text(rnd)}") for i in range(150)]
    rows += [(300 + i, garble(rows[i][1].split(". ")[0] + ".", "utf-8", "mac_roman") + f" Another text altogether, number {i}.") for i in range(12)]
    got = run(spark, rows)
    assert got.keys() == set(range(300, 312)) and all(r.by_twin for r in got.values())
    assert all(got[300 + i].restored.startswith(rows[i][1].split(". ")[0]) for i in range(12))


def test_entities_that_stand_for_garbled_characters(spark):
    rnd = random.Random(7)
    rows = [(i, clean_text(rnd)) for i in range(200)]
    rows += [(300 + i, garble(rows[i][1], "utf-8", "cp1252")) for i in range(30)]
    rows += [(400, "The Caf&#195;&#169; near S&#xC3;&#xA3;o &#8211; open"), (401, "The Caf&#233; of O&#8217;Neill &amp; sons, &#233;&#8217; &lt;&gt;"), (402, "Caf&Atilde;&copy; and M&#252;nchen")]
    got = run(spark, rows)
    assert got.keys() == {*range(300, 330), 400, 402}
    assert got[400].restored == "The Café near São &#8211; open" and got[402].restored == "Café and M&#252;nchen"


def test_lost_characters_come_back_from_a_twin(spark):
    rnd = random.Random(8)
    rows = [(i, clean_text(rnd)) for i in range(200)]
    rows += [(300 + i, garble(rows[i][1], "utf-8", "cp1252")) for i in range(20)]
    rows += [(400, "Акции снова выросли в мае на 4 % in the first half of it."), (401, "Акции снова выросли в �������� на 4 % in the first half of it."), (402, "Акции снова ������� в мае на 4 % in the first half of it.")]
    got = run(spark, rows)
    assert got.keys() == {*range(300, 320), 401, 402}
    assert got[402].restored == rows[-3][1] and not got[402].lost and got[401].lost and got[401].restored == rows[-2][1]
