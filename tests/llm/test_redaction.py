"""What redaction leaves of secrets that have more than one line or rule."""

import base64
import random
import re

import pytest

from tamis.llm import secrets

BODY = base64.b64encode(random.Random(7).randbytes(1200)).decode()
LINES = [BODY[i : i + 64] for i in range(0, len(BODY), 64)]


def redacted(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return secrets.redact(docs).first()["text"]


@pytest.mark.parametrize("label", ["RSA PRIVATE KEY", "PRIVATE KEY", "PGP PRIVATE KEY BLOCK"])
@pytest.mark.parametrize("gap", ["\n", "\r\n", "\n    ", "\\n"])
@pytest.mark.parametrize("end", [True, False])
def test_no_key_body_stays(spark, label, gap, end):
    head = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0011"] if gap in ("\n", "\r\n") else []
    lines = [f"-----BEGIN {label}-----", *head, *([""] if head else []), *LINES, *([f"-----END {label}-----"] if end else [])]
    found = redacted(spark, "It is so: " + gap.join(lines) + " (all of it) and well-known prose.")
    assert found == "It is so: [private_key] (all of it) and well-known prose."


def test_prose_about_keys_stays(spark):
    text = "A -----BEGIN RSA PRIVATE KEY----- line starts a key; -----BEGIN PUBLIC KEY----- does not."
    assert redacted(spark, text) == text.replace("-----BEGIN RSA PRIVATE KEY-----", "[private_key]")


@pytest.mark.parametrize("end", [True, False])
def test_long_bodies(spark, end):
    text = "-----BEGIN PRIVATE KEY-----" + ("\n" + LINES[0]) * 30000 + ("\n-----END PRIVATE KEY-----" if end else "") + "\n- done-and-over " * 9000
    found = redacted(spark, text)
    assert found.startswith("[private_key]") and not re.search(LINES[0][:20].replace("+", "."), found)
    assert found.count("done-and-over") == 9000


def test_overlapping_secrets_go_whole(spark):
    texts = {
        "ghp_" + "0a" * 12 + "QRSTUVWXYZqr": "[github]",
        "AKIA" + "A0" * 8 + "c0ffee" * 3: "[access]c0ffeec0ffeec0ffee",
        "AKIA" + "A0" * 7 + "42" * 8 + "ab" * 6: "[access]",
        "xoxb-1234567890-ghp_" + "a1" * 20 + "!": "[slack]!",
        "é𝔘 " + "token=abcdefgh é " * 600 + "end": "é𝔘 " + "[assign] é " * 600 + "end",
        "AKIA" + "A0" * 8 + ";" + "ab" * 12: "[access];[hex]",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert found == dict(enumerate(texts.values()))


def test_key_that_holds_other_secrets(spark):
    lines = ["0123456789abcdef" * 4, "AKIA" + "B7" * 30, LINES[0]]
    text = "\n".join(["-----BEGIN PRIVATE KEY-----", *lines])
    assert redacted(spark, text + "; rest") == "[private_key]; rest"


def test_no_bound_on_lines_dashes_and_headers(spark):
    """1,000 indented lines without END, 500 dash runs and 60 headers before the body."""
    indented = "-----BEGIN RSA PRIVATE KEY-----" + "".join(f"\n    {x}" for x in LINES * 40)
    assert redacted(spark, f"a {indented} b") == "a [private_key] b"
    dashes = "-----BEGIN PRIVATE KEY-----\n" + "a-b--c\n" * 500 + "\n".join(LINES) + "\n-----END PRIVATE KEY-----"
    assert redacted(spark, f"a {dashes} b") == "a [private_key] b"
    headers = "-----BEGIN PRIVATE KEY-----\n" + "Some-Header: x-y\n" * 60 + "\n" + "\n".join(LINES)
    assert redacted(spark, f"{headers}; b") == "[private_key]; b"


def test_rule_without_trigrams_keeps_its_whole_expression(spark):
    rule = secrets.SecretRule("odd", "[xyzuvwabc][0-9]+", least=5)
    docs = spark.createDataFrame([(1, "x1234 y12 z99999"), (2, "x123")], "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["secrets"]] for r in secrets.scan_secrets(docs, [rule]).collect()}
    assert found == {1: [(0, 5), (10, 16)], 2: []}
