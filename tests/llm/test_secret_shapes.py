"""Secrets that no run of 16 characters with a digit shows."""

from __future__ import annotations

import random
import string

from pyspark.sql import functions as F

from transitlens.llm import secrets

SHORT = {
    1: ("login password=hunter2 done", "hunter2"),
    2: ("password=Tr0ub4dor&3", "Tr0ub4dor&3"),
    3: ("use token=QwErTyUiOpAsDfGh here", "QwErTyUiOpAsDfGh"),
    4: ('{"db_password": "a.b!c@d$e"}', "a.b!c@d$e"),
    5: ("API_KEY='abcdefgh12345678!xyz',", "abcdefgh12345678!xyz"),
    6: ("the password x9!kk as said", "x9!kk"),
    7: ("secret := correcthorse", "correcthorse"),
    8: ("key QwErTyUiOpAsDfGh alone", "QwErTyUiOpAsDfGh"),
    9: ('{"token":"s3cr.et","user":"bob"}', "s3cr.et"),
    10: ("passwd: Gänse#1", "Gänse#1"),
    11: ('token = "it\'s.9"###', "it's.9"),
    12: ("password: secret", "secret"),
}


def test_candidates_of_any_length_and_kind_where_a_name_says_so(make_docs):
    docs = make_docs([(i, t, None, None) for i, (t, _) in SHORT.items()]).withColumn("path", F.lit(""))
    found = {(r.doc_id, r.candidate) for r in secrets.candidates(docs).collect()}
    assert {(i, c) for i, (_, c) in SHORT.items()} <= found


def test_plain_words_beside_a_name_are_no_candidates(make_docs):
    docs = make_docs([(1, "the token counts of Donaudampfschifffahrt say some-lower-case-slug", None, None)])
    assert secrets.candidates(docs.withColumn("path", F.lit(""))).count() == 0


def test_the_forest_decides_on_short_and_digit_free_values(make_docs):
    r = random.Random(3)
    pick = lambda kinds, n: "".join(r.choice(kinds) for _ in range(n))
    rows, truth = [], {}
    for i in range(240):
        kind = i % 4
        value = (
            pick(string.ascii_lowercase, 5) + str(r.randrange(10, 99)) if kind == 0
            else pick(string.ascii_letters, 9) + "." + pick("!@$", 1) + pick(string.digits, 2) if kind == 1
            else pick(string.ascii_uppercase, 8) + pick(string.ascii_lowercase, 8) if kind == 2
            else r.choice(["required", "empty", "none", "optional"])
        )
        name = r.choice(["password", "token", "api_key"])
        rows.append((i, f"set {name}={value} and go", "en", "app.cfg"))
        truth[i] = (value, kind < 3)
    got = secrets.scan(make_docs(rows), learn_from=F.col("doc_id") < 160).where("doc_id >= 160").collect()
    by = {(x.doc_id, x.candidate): x.is_secret for x in got}
    right = [by.get((i, v)) == is_secret for i, (v, is_secret) in truth.items() if i >= 160]
    assert len(right) == 80 and sum(right) >= 76
