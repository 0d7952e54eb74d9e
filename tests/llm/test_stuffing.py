import random

import pytest

from logstrata.llm import stuffing

SCHEMA = "doc_id bigint, host string, text string, share double, kind int"
WORDS = "solar lamps,garden chairs,running shoes,travel bag,winter tyres,phone cases,dog beds,wall clock".split(",")
MODS = "cheap,best,buy,sale,online,reviews,wholesale,near me".split(",")
WHO = "The keeper of the mill,A retired clockmaker,Our northern warehouse,The choir of the village,Nobody at the station,The price of garden chairs".split(",")
DID = "refused to sign the paper,counted the boats before noon,learned to work without power,measured the depth of the pond,asked the neighbours for advice".split(",")
HOW = "after the first frost,with help from two friends,on the far side of the lake,in spite of the noise".split(",")


def corpus(seed=1, n=240):
    r = random.Random(seed)
    rows, spam = [], set()
    prose = lambda: f"{r.choice(WHO)} {r.choice(DID)} {r.choice(HOW)}."
    pair = lambda: f"{r.choice(MODS)} {r.choice(WORDS)}" if r.random() < 0.6 else r.choice(WORDS)
    for i in range(n):
        menu = " | ".join(r.sample(["Home", "News", "Contact", "Help", "Archive", "Gallery"], 4))
        kind = i % 8
        if kind == 0:
            body = [", ".join(pair() for _ in range(30)), " ".join(pair() for _ in range(30))]
        elif kind == 1:
            body = [f"[{pair()}](https://shop{r.randint(1, 99)}.example/p/{r.randint(1, 999)})" for _ in range(12)] if i % 16 == 1 else [pair() for _ in range(30)]
        elif kind == 2:
            body = [f"{r.randint(1, 28):02d}.03. {r.randint(1, 12)}:15 {r.randint(1, 30)} °C {r.randint(900, 1030)} hPa" for _ in range(15)]
        elif kind == 3:
            body = [prose() + " " + prose() + " " + prose(), ", ".join(pair() for _ in range(4))]
        else:
            body = [" ".join(prose() for _ in range(r.randint(2, 9))) for _ in range(4)]
        if kind in (0, 1):
            spam.add(i)
        rows.append((i, f"h{i % 40}.example", "\n".join([menu, "We use cookies here. Accept | Reject", *body, "All rights reserved."])))
    return rows, spam


def test_spam_is_told_from_prose_and_facts(spark):
    rows, spam = corpus()
    df = spark.createDataFrame([(*x, 1.0, 1) for x in rows], SCHEMA)
    assert {r.doc_id for r in stuffing.stuffed_pages(df).collect()} == spam


def test_odd_texts(spark):
    rows, spam = corpus()
    odd = [None, "", " \n\t", "\u00ad\u200b", "\ufffd" * 500, "<|endoftext|>" * 40, "a" * 100_000, "404\nNot found", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"]
    extra = [(1000 + i, None, t) for i, t in enumerate(odd)] + [(2000, "h1.example", dict((i, t) for i, _, t in rows)[0])] * 2 + [(None, "h2.example", None)]
    df = spark.createDataFrame([(*x, 1.0, 1) for x in rows + extra], SCHEMA)
    assert sorted(r.doc_id for r in stuffing.stuffed_pages(df).collect()) == sorted(spam | {2000})
    assert stuffing.stuffed_shares(df).count() == len(rows) + len(extra)
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def learnt(spark):
    rows, spam = corpus()
    df = spark.createDataFrame([(*x, 1.0, 1) for x in rows], SCHEMA)
    pages = stuffing.parsed(df.select("doc_id", "host", "text")).persist()
    return rows, spam, pages, stuffing.learn_phrases(pages).persist()


def found(shares):
    return {r.doc_id for r in shares.collect() if r.share > 0.5}


def test_phrases_decide_and_form_alone_does_not(learnt):
    rows, spam, pages, phrases = learnt
    assert found(stuffing.page_shares(pages, phrases)) == spam
    assert found(stuffing.page_shares(pages, phrases.limit(0))) == set()
    # phrases of lists turned into those of sentences
    turned = phrases.selectExpr("phrase", "edge", "CAST(-value AS FLOAT) AS value")
    assert len(found(stuffing.page_shares(pages, turned)) & spam) < len(spam) / 4


def test_broadcast_and_groups_give_the_same(learnt):
    _, _, pages, phrases = learnt
    one = {r.doc_id: r.share for r in stuffing.page_shares(pages, phrases).collect()}
    assert {r.doc_id: r.share for r in stuffing.page_shares(pages, phrases, broadcast_phrases=0, group_words=2000).collect()} == one


def test_no_phrase_is_dropped(spark):
    # more words, each on the same number of hosts, than any fixed size would hold
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(60_999)] + ["яблоки"]
    lists = [", ".join(words[at : at + 50]) for at in range(0, len(words), 50)]
    df = spark.createDataFrame([(h, f"h{h}.example", "\n".join(["Start", *lists, "The end"]), 1.0, 1) for h in range(3)], SCHEMA)
    got = {r.phrase: r for r in stuffing.learn_phrases(stuffing.parsed(df)).collect()}
    hashes = stuffing._Hashes()
    assert {hashes[w] for w in words} <= set(got)
    assert got[hashes["start"]].edge and not got[hashes["яблоки"]].edge


def test_every_line_is_counted_and_hosts_are(spark):
    page = "Home | News | Help\n" + "\n".join(["cheap lamps"] * 3) + "\nThe end of it."
    df = spark.createDataFrame([(i, f"h{i % 2}.example", page, 1.0, 1) for i in range(9)], SCHEMA)
    assert stuffing.learn_phrases(stuffing.parsed(df)).count() == 0  # two hosts only
    df = spark.createDataFrame([(i, f"h{i}.example", page, 1.0, 1) for i in range(3)], SCHEMA)
    got = {r.phrase: r for r in stuffing.learn_phrases(stuffing.parsed(df)).collect()}
    hashes = stuffing._Hashes()
    assert got[hashes["news"]].edge and got[hashes["end"]].edge


def test_text_read_in_a_wrong_charset():
    prose = "Вечерний паром меняет маршрут второй раз до открытия рынка."
    for wrong in ("latin-1", "cp1252"):
        assert stuffing.line_form(prose.encode().decode(wrong, "replace"))[2][-1] == "рынка"
    assert stuffing.repaired("été à l'ombre") == "été à l'ombre"
    assert not stuffing.is_damaged("¿Busca sillas? ¡sillas aquí! à la fin, über 30 °C")


def test_links_to_internationalised_hosts_are_counted():
    assert stuffing.line_form("www.пример.рф/а www.例え.テスト/b WWW.пример.рф/в")[0] == stuffing._STRONG
    assert stuffing.line_form("shop-.example")[0] == stuffing._STRONG


def test_repetition_is_measured_in_windows():
    assert stuffing.distinct_part(["a", "b"] * 50) < 0.2
    assert stuffing.distinct_part([f"w{i % 40}" for i in range(400)]) == 1.0
    assert stuffing.distinct_part([]) == 1.0
