"""The same results in DuckDB's SQL, written from the contracts and not from the operators."""

from __future__ import annotations

MIXING = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), w AS (
  SELECT key, count(*) AS n, row_number() OVER (ORDER BY key) AS i FROM d GROUP BY key
), q AS (
  SELECT key, i, n, sqrt(n) / (SELECT list_sum(list(sqrt(n) ORDER BY key)) FROM w) * (4000 - (SELECT count(*) FROM w)) AS share FROM w
), p AS (
  SELECT key, i, n, CAST(1 + floor(share) + CASE WHEN row_number() OVER (ORDER BY floor(share) - share, key) <= 4000 - count(*) OVER () - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS parts FROM q
), a AS (
  SELECT list(parts ORDER BY i) AS ps, CAST(sum(parts) AS BIGINT) AS period, CAST(max(ceil((n + 15) // 16 * 4000 / parts)) AS BIGINT) AS needed FROM p
), r(t, had, pick) AS (
  SELECT CAST(0 AS BIGINT), list_transform(ps, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM a
  UNION ALL
  SELECT t + 1, list_transform(had, lambda h, j: CASE WHEN j = chosen THEN h + 1 ELSE h END), chosen FROM (
    SELECT t, had, list_min(list_filter(list_transform(had, lambda h, j:
      CASE WHEN h * period // ps[j] <= t THEN ((h + 1) * period + ps[j] - 1) // ps[j] * 10000 + j END), lambda x: x IS NOT NULL)) % 10000 AS chosen
    FROM r, a WHERE t < least(period, needed))
), slots AS (
  SELECT pick AS i, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM r WHERE t > 0
), ranked AS (
  SELECT doc_id, source, key, row_number() OVER (PARTITION BY key ORDER BY h, doc_id) - 1 AS n FROM d
)
SELECT doc_id, source, CAST(n // 16 AS BIGINT) AS block, CAST((n // 16) // parts * period + s.slot AS BIGINT) AS slot,
  CAST(((n // 16) // parts * period + s.slot) * 16 + n % 16 AS BIGINT) AS position, parts / period AS weight
FROM (SELECT ranked.doc_id, ranked.source, ranked.n, p.i, p.parts FROM ranked JOIN p USING (key)) JOIN a ON true JOIN slots s USING (i) WHERE s.turn = (n // 16) % parts
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Fixed values, stated here once more so that the SQL does not follow the operator: countries by the length of their IBANs, and of each kind the base score, the words that raise it and those that lower it.
_IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN = "(?:" + "|".join(f"(?:{'|'.join(names.split())})[0-9][0-9](?: ?[A-Z0-9]){{{length - 4}}}" for length, names in _IBAN_COUNTRIES.items()) + ")"
_SCORES = {
    "email": (0.9, "mail mails email contact write correo courriel", ""),
    "ip": (0.6, "ip address host server login", "version release section chapter"),
    "card": (0.8, "card visa mastercard credit karte carte tarjeta", "isbn order serial tracking"),
    "phone": (0.7, "phone telephone telefon call tel mobile fax whatsapp", ""),
    "iban": (0.8, "iban account bank konto compte cuenta", ""),
}
_WINDOW = 40

#: The contract's patterns, and for IBANs one without lookaround.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"\b{_IBAN}\b",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INT) ELSE CAST(reverse({_DIGITS})[i] AS INT) * 2 // 10 + CAST(reverse({_DIGITS})[i] AS INT) * 2 % 10 END)) % 10 = 0"
_MOVED = "(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4))"
_VALID = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS DOUBLE))) <= 255",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
    "iban": f"length({_MOVED}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split({_MOVED}, ''), lambda c: CAST(ascii(c) AS INT))), lambda a, c: CASE WHEN c < 65 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1",
}


def _near(words: str, amount: str) -> str:
    """The amount if one of the words stands whole in the text around."""
    return f"CASE WHEN regexp_matches(around, '(?:^|[^a-z])(?:{'|'.join(words.split())})(?:[^a-z]|$)') THEN {amount} ELSE 0 END" if words else "0"


def _pii() -> str:
    matched = " UNION ALL ".join(
        f"SELECT rid, t, '{k}' AS kind, {i} AS ord, regexp_extract_all(t, '{_PLAIN[k]}') AS ms, regexp_split_to_array(t, '{_PLAIN[k]}') AS ps FROM d WHERE regexp_matches(t, '{_PLAIN[k]}')" for i, k in enumerate(_SCORES)
    )
    fine = " OR ".join(f"(kind = '{k}' AND CASE WHEN kind = '{k}' THEN {_VALID[k]} END)" for k in _SCORES)
    score = "CASE kind " + " ".join(f"WHEN '{k}' THEN {base}::DOUBLE + {_near(more, '0.1::DOUBLE')} - {_near(less, '0.3::DOUBLE')}" for k, (base, more, less) in _SCORES.items()) + " END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({matched}),
e AS (SELECT rid, t, kind, ord, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, unnest(ps[2:len(ms) + 1]) AS after FROM x),
s AS (SELECT *, sum(length(p)) OVER w + sum(length(m)) OVER w - length(m) AS a FROM e WINDOW w AS (PARTITION BY rid, kind ORDER BY i)),
f AS (SELECT rid, kind, ord, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS b,
  lower(right(p, {_WINDOW}) || ' ' || left(after, {_WINDOW})) AS around FROM s WHERE {fine}),
g AS (SELECT rid, kind, ord, a, kind || ':' || a || ':' || b AS span, printf('%.2f', {score}) AS score FROM f),
o AS (SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
  count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'iban') AS n_iban, string_agg(span, ',' ORDER BY ord, a) FILTER (kind <> 'iban') AS base,
  string_agg(span, ',' ORDER BY ord, a) AS spans, string_agg(score, ',' ORDER BY ord, a) AS scores FROM g GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores, coalesce(n_iban, 0)::BIGINT AS n_iban
FROM d LEFT JOIN o USING (rid)
"""


PII = _pii()


def crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text expression."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(range(8), lambda c, i: {step}, xor(crc, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda crc, b: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


LANGUAGE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce({crc32("CAST(doc_id AS VARCHAR)")}, 0) % 4 = 2 AS held_out,
    coalesce(regexp_matches(text, '\\p{{L}}'), false) AS letters, regexp_replace(' ' || lower(text) || ' ', '[^\\p{{L}}]+', ' ', 'g') AS t FROM documents
), c AS (
  SELECT rid, unnest(string_split(t, '')) AS a, unnest(range(length(t))) AS i FROM d WHERE letters
), w AS (
  SELECT rid, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM c WINDOW o AS (PARTITION BY rid ORDER BY i)
), g AS (
  SELECT rid, gram, count(*) AS n FROM (
    SELECT rid, a AS gram FROM w WHERE a <> ' ' UNION ALL SELECT rid, a || b FROM w WHERE b IS NOT NULL UNION ALL SELECT rid, a || b || c FROM w WHERE c IS NOT NULL) GROUP BY ALL
), p AS (
  SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(gram), gram) - 1 AS place FROM g JOIN d USING (rid) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram QUALIFY place < 300
), own AS (
  SELECT rid, gram, row_number() OVER (PARTITION BY rid ORDER BY n DESC, length(gram), gram) - 1 AS place FROM g QUALIFY place < 300
), away AS (
  SELECT own.rid, l.lang, sum(CASE WHEN p.place IS NULL THEN 300 ELSE least(abs(p.place - own.place), 300) END) AS far, count(*) AS k
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.gram = own.gram GROUP BY ALL
), best AS (
  SELECT rid, lang, 1 - far / (300 * k) AS score FROM away QUALIFY row_number() OVER (PARTITION BY rid ORDER BY far, lang) = 1
)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN best USING (rid)
"""


def _clustering(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds, each as a query over all vectors and centroids."""
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = lambda i: f"a{i} AS MATERIALIZED (SELECT rid, vec_id, x, c, d FROM (SELECT v.rid, v.vec_id, v.x, c.c, {apart} AS d FROM v, c{i} c) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"
    mean = lambda i: f"""m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range(len(x))) AS i FROM a{i}) GROUP BY c, i) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (c))"""  # noqa: E731
    steps = ",\n".join(f"{nearest(i)},\n{mean(i)}" for i in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY c < {k}
), {steps},
{nearest(rounds)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(list_aggregate(c{rounds}.x, 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""


CLUSTERING = _clustering()
