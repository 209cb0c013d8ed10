"""p6: what is personal is replaced, what only looks like it stays, and the rest of the text is unchanged."""

import pytest

from loomlog.llm import pii

D = pii.Detector(["Lidia", "Maria", "Jan"])


@pytest.mark.parametrize("text, want", [
    ("mail a.b+c@mail.example.com now", "mail [EMAIL] now"), ("a.b [at] mail [dot] example [dot] com", "[EMAIL]"), ("x%40mail.example.com", "[EMAIL]"), ("ａ.b＠mail.example.com", "[EMAIL]"), ("call +49 30 1234567 today", "call [PHONE] today"), ("(212) 555-0134", "[PHONE]"), ("phone 020 7946 0958", "phone [PHONE]"), ("(030) 123456", "[PHONE]"),
    ("SSN 123-45-6789", "[ID_NUMBER]"), ("CPF 123.456.789-09", "[ID_NUMBER]"), ("12 Long Oak Street", "[ADDRESS]"), ("Hauptstraße 5", "[ADDRESS]"), ("12 rue de la Paix", "[ADDRESS]"), ("Via Roma 12", "[ADDRESS]"), ("Lidia Rorvetti asked", "[NAME] asked"), ("Rorvetti, Lidia", "[NAME]"), ("LIDIA RORVETTI", "[NAME]"),
    ("Author: Priya Raghavan <p@x.example.com>", "Author: [NAME] <[EMAIL]>"), ("Dr. Nguyen Tran", "[NAME]"), ("/home/lidia.rorvetti/src", "/home/[NAME]/src"), ("Lіdia Rorvetti", "[NAME]"), ("Lid​ia Rorvetti", "[NAME]"),
])
def test_found(text, want):
    assert D.redact(text) == want


@pytest.mark.parametrize("text", [
    "", "   ", "ssh ci@build-20.example.com", "git@git.example.com:a/b.git", "https://user@host.example.com/x", "npm i @scope/name@1.2.3", "rev 212-555-0134", "version 020 7946 0958", "SKU 959-32-6563", "127.0.0.1:15662", "Kubernetes Dashboard", "Trello Board", "Version Comparison", "Apple Keyboard", "Setup Wizard", "Third Person",
    "/home/data.loader/x", "Main Branch", "Merge Queue: 4 Entry Points", "at=1774743773261", "-rw-r--r-- 1 root root 4096 a.txt",
])
def test_left_alone(text):
    assert D.redact(text) == text and D.kinds(text) == set()


def test_long_texts_are_read_to_the_end():
    text = "x " * 200_000 + "Lidia Rorvetti " + "y " * 200_000 + "a@b.example.com"
    assert D.redact(text) == "x " * 200_000 + "[NAME] " + "y " * 200_000 + "[EMAIL]"


def test_table_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "Lidia Rorvetti", None), (1, "Lidia Rorvetti", None), (2, "", "a@b.example.com")], "k long, a string, b string")
    got = sorted(tuple(r) for r in pii.scan(df, "t", "k", ["a", "b"], ["Lidia"], True).collect())
    assert len(got) == 6 and ("t", "1", "b", None) in got and ("t", "2", "a", "") in got and ("t", "2", "b", "[EMAIL]") in got
    assert {tuple(r) for r in pii.scan(df, "t", "k", ["a", "b"], ["Lidia"]).collect()} == {("t", "1", "a", "NAME"), ("t", "2", "b", "EMAIL")}
    assert pii.scan(df.limit(0), "t", "k", ["a", "b"], [], True).count() == 0 and pii.scan(df, "t", "k", ["a"], []).count() >= 0
