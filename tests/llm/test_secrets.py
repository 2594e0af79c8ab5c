import hashlib
import random
import re

import duckdb
import pytest

from staywise.llm import secrets, sql
from staywise.llm.automaton import PatternError, Rule, compile_rules, determinise, byte_classes, parse
from staywise.llm.queries import op11_secret_scan
from tests.llm.conftest import frame

PIECES = [
    "password", "passwd", "PASSWORD", "secret", "token", "api_key", "apikey", "apiKey", "tok", "api_", '"', "'", " ", "  ", ":", "=", "==",
    "abc", "a1b2c3", "AKIA", "AKIAABCDEFGHIJKL", "0123456789", "deadbeef" * 2, "deadbeef" * 4, "é", "ſecret", "Key", "日", "\n",
    "ghp_", "ghp_" + "a1" * 18, "xoxb-", "xoxb-123-abcdefg", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-", "z", "A" * 10, "😀",
]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for k, rule in enumerate(secrets.MORE_RULES, 3):
        found += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, text) if re.fullmatch(rule.keep or rule.pattern, m[0])]
    return sorted(found)


def texts(seed, count):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(1, 14))) for _ in range(count)]


def test_one_pass_against_separate_searches():
    scanner = compile_rules(secrets.RULES)
    for text in texts(1, 20_000):
        assert secrets.spans_of(text.encode(), scanner) == brute(text), text


def test_state_is_carried_across_segments(monkeypatch):
    monkeypatch.setattr("staywise.llm.automaton.SEGMENT", 7)
    scanner = compile_rules(secrets.RULES)
    for text in texts(2, 2000):
        assert secrets.spans_of(text.encode(), scanner) == brute(text), text


@pytest.mark.parametrize("pattern", ["a(b|c)+d?", "(ab|a)(c|bc)", "a{2,4}", "[a-c]{3}x*", "\\x41\\.b?", "(a|b)*c"])
def test_subset_construction_matches_regex(pattern):
    tree = parse(pattern)
    machine = determinise(tree, byte_classes([tree]))
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice("abcdxA.") for _ in range(r.randint(0, 7)))
        state = 0
        for byte in text.encode():
            state = machine.steps[state][machine.classes[byte]] if state >= 0 else state
        assert (state in machine.final) == bool(re.fullmatch(pattern, text)), (pattern, text)


def test_minimal():
    tree = parse("(ab|cb|db)")
    # start, after a/c/d, end
    assert len(determinise(tree, byte_classes([tree])).steps) == 3


@pytest.mark.parametrize("pattern", ["a*", "ab|abcd", "abcd|c", "[^a]", "(a", "a.b", "ü"])
def test_refused_patterns(pattern):
    with pytest.raises(PatternError):
        compile_rules((Rule("k", pattern),))


def expected(rows):
    kinds = [rule.kind for rule in secrets.RULES]
    out = []
    for doc, text, _ in rows:
        spans = brute(text or "")
        named = [f"{kinds[k]}:{a}:{b}" for a, k, b in spans]
        base = ",".join(name for name, (_, k, _) in zip(named, spans) if k < 3)
        out.append((doc, *[sum(k == n for _, k, _ in spans) for n in range(3)], hashlib.sha256(base.encode()).hexdigest(), ",".join(named)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(odd_rows):
    long = "word ñ " * 30_000 + "password=abcdef123 " + "deadbeef" * 5000
    more = [(k + 1000, text, "s") for k, text in enumerate(texts(4, 300))]
    return odd_rows + more + [(None, "token: abcdefg", "s"), (None, "secret=1234567", "s"), (5000, long, "s"), (5000, "AKIA" + "B" * 70_000, "s")]


def run(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("secrets"))
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    return folder, sorted((tuple(r) for r in op11_secret_scan(spark, folder).collect()), key=str)


def test_query_and_sql(spark, rows, tmp_path_factory):
    folder, made = run(spark, rows, tmp_path_factory)
    assert made == expected(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(con.sql(sql.secret_scan()).fetchall(), key=str) == made


def test_empty(none):
    assert secrets.scan(none).count() == 0


def test_more_rules_leave_base_spans(spark, rows):
    docs = frame(spark, rows[:200])
    base = secrets.scan(docs, secrets.BASE_RULES).select("doc_id", secrets.listed().alias("s"))
    kinds = [rule.kind for rule in secrets.BASE_RULES]
    both = secrets.scan(docs).select("doc_id", secrets.listed(kinds).alias("s"))
    assert sorted(map(tuple, base.collect()), key=str) == sorted(map(tuple, both.collect()), key=str)
