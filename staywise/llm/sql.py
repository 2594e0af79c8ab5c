"""SQL that states what the corpus queries must return, where SQL can."""

from __future__ import annotations

from staywise.llm.licences import COPYRIGHT_LINE, DIGESTS, LICENCES, LINE_END, NOT_WORD, NOTICES, SENTENCE_END, SPELLINGS, WRAPPED, headed
from staywise.llm.mixing import DIGITS, SEED
from staywise.llm.queries import EPOCHS, WEIGHTS


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def exact_dedup() -> str:
    return r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS form FROM documents)
SELECT doc_id,
  min(doc_id) OVER same AS keep_id,
  count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept,
  sha256(form) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY form)"""


def mixing() -> str:
    listed = ", ".join(f"({quoted(name)}, {weight!r}::DOUBLE)" for name, weight in WEIGHTS.items())
    return f"""
WITH weights(source, weight) AS (VALUES {listed}),
sizes AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, {EPOCHS!r}::DOUBLE * (sum(size) OVER ()) * (weight / sum(weight) OVER ()) / size AS rate
  FROM sizes JOIN weights USING (source) WHERE size > 0),
each AS (
  SELECT DISTINCT d.source, CASE WHEN w.source IS NULL THEN {EPOCHS!r}::DOUBLE ELSE r.rate END AS rate
  FROM documents d LEFT JOIN weights w ON w.source = d.source LEFT JOIN rates r ON r.source = d.source),
steps AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
  FROM (SELECT source, rate, unnest(generate_series(0, ceil(rate + 60 + 14 * sqrt(rate))::BIGINT)) AS k FROM each WHERE rate > 0)),
drawn AS (
  SELECT d.*, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.upto < 1 - pow(2, -52) AND s.upto <=
    ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || coalesce(d.text, '')), 1, {DIGITS}))::BIGINT::DOUBLE
    / pow(16, {DIGITS})) AS n
  FROM documents d)
SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, n))::INT AS copy FROM drawn WHERE n > 0"""


def lower_lines(text: str) -> str:
    lines = f"regexp_replace(lower({text}) || chr(10), {quoted(LINE_END.replace('x{0B}', 'x0B').replace('x{0C}', 'x0C'))}, chr(10), 'g')"
    return f"regexp_replace({lines}, {quoted(WRAPPED)}, ' copyright \\1', 'g')"


def words_only(lines: str) -> str:
    form = f"' ' || replace(regexp_replace({lines}, {quoted(NOT_WORD)}, ' ', 'g'), chr(10), ' ' || chr(10) || ' ')"
    for spelt, meant in SPELLINGS:
        form = f"replace({form}, ' {spelt} ', ' {meant} ')"
    return form


def canonical(lines: str) -> str:
    return words_only(f"regexp_replace({lines}, {quoted(COPYRIGHT_LINE)}, '\\1', 'g')")


def flat(text: str) -> str:
    return f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'))"


def licence_scan() -> str:
    noted = [(name, text) for name, found in NOTICES.items() for text in found]

    def values(rows: list[tuple[str, str]]) -> str:
        return ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in rows)

    def digest(text: str) -> str:
        return f"sha256({flat(canonical(lower_lines(text)))})"

    given = values([(name, found) for name, digests in DIGESTS.items() for found in digests])
    sentences = f"regexp_replace(array_to_string(regexp_extract_all(lowered, {quoted(COPYRIGHT_LINE)}), ''), {quoted(SENTENCE_END)}, chr(10), 'g')"
    return f"""
WITH whole AS (
  SELECT digest, min(name) AS licence FROM (
    SELECT {digest('body')} AS digest, name FROM (VALUES {values(headed(LICENCES) + noted)}) AS t(name, body)
    UNION ALL SELECT digest, name FROM (VALUES {given}) AS t(name, digest)) GROUP BY digest),
notice AS (
  SELECT form, min(name) AS licence FROM (
    SELECT {flat(canonical(lower_lines('body')))} AS form, name FROM (VALUES {values(noted)}) AS t(name, body)) GROUP BY form),
lowered AS (SELECT doc_id, {lower_lines("coalesce(text, '')")} AS lowered FROM documents),
forms AS (SELECT row_number() OVER () AS row, doc_id, {canonical('lowered')} AS form, {words_only(sentences)} AS said FROM lowered),
lines AS (
  SELECT row, {flat('line')} AS form FROM (SELECT row, unnest(string_split(form || chr(10) || said, chr(10))) AS line FROM forms)),
named AS (
  SELECT row, count(*) AS n_notices, string_agg(DISTINCT licence, ' ' ORDER BY licence) AS notices
  FROM lines JOIN notice USING (form) GROUP BY row),
digests AS (SELECT row, doc_id, sha256({flat('form')}) AS digest FROM forms)
SELECT doc_id, digest, w.licence, coalesce(n.n_notices, 0) AS n_notices, coalesce(n.notices, '') AS notices
FROM digests LEFT JOIN whole w USING (digest) LEFT JOIN named n USING (row)"""


def either_case(words: str) -> str:
    """ASCII letters in either case, spelt out: the engine's own folding would add letters beyond ASCII."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


def secret_scan() -> str:
    """Successive matches of every pattern; the next match's place is where its text occurs first in what is left."""
    named = f"""({either_case("password|passwd|secret|token|api_?key")})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]"""
    # kind, order, pattern of a match, whole pattern of a match that counts
    rules = (
        ("assign", named + "+)", named + "{6,})"),
        ("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"),
        ("hex", "[0-9a-f]+", "[0-9a-f]{24,}"),
        ("github", "gh[opsur]_[A-Za-z0-9]+", "gh[opsur]_[A-Za-z0-9]{36,}"),
        ("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}"),
        ("private_key", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
    )
    # Only texts with a match that counts are walked; short hexadecimal runs would be most of a text.
    walked = "[0-9a-f]{24,}"
    texts = " UNION ALL ".join(
        f"SELECT row, {k} AS rule, text, regexp_extract_all(text, '{walked if kind == 'hex' else form}') AS found FROM numbered"
        for k, (kind, form, _) in enumerate(rules)
    )
    kinds = " ".join(f"WHEN {k} THEN '{kind}'" for k, (kind, _, _) in enumerate(rules))
    kept = " ".join(f"WHEN {k} THEN regexp_full_match(part, '{keep}')" for k, (_, _, keep) in enumerate(rules))
    count = ", ".join(f"count(*) FILTER (WHERE rule = {k}) AS n_{kind}" for k, (kind, _, _) in enumerate(rules[:3]))
    return f"""
WITH RECURSIVE numbered AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
searched AS ({texts}),
walk(row, rule, found, k, rest, start, stop, part) AS (
  SELECT row, rule, found, 0, text, 0::BIGINT, 0::BIGINT, '' FROM searched WHERE len(found) > 0
  UNION ALL
  SELECT row, rule, found, k + 1, substr(rest, place + length(piece)), stop + place - 1, stop + place - 1 + length(piece), piece
  FROM (SELECT *, found[k + 1] AS piece, strpos(rest, found[k + 1]) AS place FROM walk WHERE k < len(found))),
spans AS (
  SELECT row, rule, start, (CASE rule {kinds} END) || ':' || start || ':' || stop AS span
  FROM walk WHERE k > 0 AND CASE rule {kept} END),
grouped AS (
  SELECT row, {count},
    string_agg(span, ',' ORDER BY start, rule) FILTER (WHERE rule < 3) AS base,
    string_agg(span, ',' ORDER BY start, rule) AS spans FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM numbered LEFT JOIN grouped USING (row)"""


def ranked_search() -> str:
    upper = "".join(chr(c) for c in range(65, 91))
    terms = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {terms} AS terms FROM documents),
lengths AS (SELECT row, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
asked AS (
  SELECT DISTINCT query, item_id, unnest(terms) AS term
  FROM (SELECT row_number() OVER () AS query, * FROM (SELECT DISTINCT item_id, {terms} AS terms FROM benchmark))),
postings AS (
  SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(total.docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
  FROM postings, total GROUP BY term),
impacts AS (
  SELECT term, row, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total.docs) // total.terms))) AS part
  FROM postings JOIN weights USING (term) JOIN lengths USING (row), total),
scores AS (
  SELECT query, any_value(item_id) AS item_id, row, sum(part)::BIGINT AS score
  FROM asked JOIN impacts USING (term) GROUP BY query, row HAVING sum(part) > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN lengths USING (row)) WHERE rank <= 10"""


def statements() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup(), "op8_source_mixing": mixing(), "op10_licence_scan": licence_scan(), "op11_secret_scan": secret_scan(), "op13_ranked_search": ranked_search()}
