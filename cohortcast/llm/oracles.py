"""SQL of the text operators that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations


from cohortcast.llm import codes, mixing, negatives, quality, secrets, sharding

WORDS = r"[^\x20\x09-\x0D]+"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(kind: str, pattern: str, keep: str) -> str:
    """(rid, kind, s, e) of a rule: an end is the sum of the gaps and matches up to it."""
    p = quoted(pattern)
    return f"""
    SELECT rid, {quoted(kind)} AS kind, e - length(m) AS s, e FROM (
      SELECT rid, m, sum(length(m) + length(g)) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM (
        SELECT rid, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
          SELECT rid, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gs FROM d WHERE regexp_matches(t, {p}))))
    WHERE {keep}"""


def _entropy_keep(kind: secrets.CharClass) -> str:
    folded = "lower(m)" if kind.fold else "m"
    w = secrets.WINDOW
    other = "true" if kind.fold else "NOT regexp_full_match(m, '[0-9A-Fa-f]+')"
    return f"""regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND {other} AND NOT regexp_matches(m, {quoted(secrets.PLACEHOLDER)})
      AND len([x FOR x IN string_split_regex(m, '[-_/+]') IF NOT regexp_matches(x, {quoted(secrets.PLAIN_PART)})]) > 0
      AND list_max([list_aggregate(string_split(substr({folded}, i, {w}), ''), 'entropy') FOR i IN range(1, length(m) - {w - 2})]) >= {kind.threshold}"""


def secret_scan() -> str:
    keeps = {"assign": f"length(regexp_extract(m, {quoted(secrets.ASSIGN)}, 2)) >= {secrets.ASSIGN_CHARS}", "access": "true", "hex": "true"}
    keeps |= {c.kind: _entropy_keep(c) for c in secrets.CLASSES}
    kinds = [name for name, _, _ in secrets.RULES]
    spans = " UNION ALL ".join(_spans(name, pattern, keeps[name]) for name, pattern, _ in secrets.RULES)
    rank = "list_position([" + ", ".join(map(quoted, kinds)) + "], kind)"
    listed = f"string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, {rank}, e)"
    base = "kind IN ('assign', 'access', 'hex')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    spans AS ({spans}),
    per AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS k, count(*) FILTER (WHERE kind = 'hex') AS h,
                   {listed} FILTER (WHERE {base}) AS b, {listed} AS every FROM spans GROUP BY rid)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
           coalesce(every, '') AS spans FROM d LEFT JOIN per USING (rid)"""


def quality_rules(rules: quality.LineRules = quality.LineRules()) -> str:
    symbols = "[" + "".join("\\" + c for c in quality.SYMBOLS) + "]"
    closers = quoted(quality.CLOSERS)
    marks = "[" + "".join("\\" + c if c in ".?" else c for c in rules.end_marks) + "]$"
    count = lambda text, pattern: f"len(regexp_extract_all({text}, {quoted(pattern)}))"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{WORDS}') AS ws FROM d),
    tri AS (SELECT rid, tri, i FROM (SELECT rid, unnest(list_zip(ws, ws[2:], ws[3:])) AS tri, generate_subscripts(ws, 1) AS i FROM w WHERE len(ws) > 2) WHERE tri[3] IS NOT NULL),
    again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM tri) WHERE n > 1),
    rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
    line AS (SELECT rid, i, l, {count('l', WORDS)} AS n, trim(l, {BLANKS}) AS body FROM (
      SELECT rid, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)),
    judged AS (SELECT rid, length(l) AS size, row_number() OVER (PARTITION BY rid, l ORDER BY i) > 1 AS dup, rtrim(body, {closers}) AS bare,
        regexp_matches(rtrim(body, {closers}), {quoted(quality.NAVIGATION.pattern.replace('(?ai)', '(?i)'))})
        OR regexp_matches(body, {quoted(quality.BOILERPLATE.pattern.replace('(?ai)', '(?i)'))})
        OR ({count('body', quality.NAV_SEPARATOR.pattern.replace('(?a)', ''))} >= {rules.nav_separators} AND n <= 12)
        OR {count('body', symbols)} > {rules.max_symbol_share} * length(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g'))
        OR ({count('body', '!')} > {rules.max_exclaim_share} * n AND n > 2)
        OR (n < {rules.open_line_words} AND NOT regexp_matches(rtrim(body, {closers}), {quoted(marks)})) AS fails
      FROM line WHERE n > 0),
    lost AS (SELECT rid, count(*) FILTER (WHERE dup) AS dups, sum(size) AS total, coalesce(sum(size) FILTER (WHERE fails), 0) AS gone FROM judged GROUP BY rid),
    m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST({count('t', symbols)} AS BIGINT) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             coalesce(gone, 0) <= {rules.max_lost_share} * coalesce(total, 0) AS good
          FROM w LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid)),
    b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM b"""


def _settled(table: str, group: str, claim: str, seats: str) -> str:
    """Seats of `table` corrected to fill the house: the next quotients gain, or the last ones lose, a seat each."""
    key = f"""CASE WHEN sum({seats}) OVER (PARTITION BY {group}) < house THEN CASE WHEN {seats} < most THEN {claim} / (2 * {seats} + 1) END
              ELSE CASE WHEN {seats} > 0 THEN -{claim} / (2 * {seats} - 1) END END"""
    return f"""SELECT * EXCLUDE ({seats}, over_, key_, place_),
        {seats} + CASE WHEN key_ IS NOT NULL AND place_ <= abs(over_) THEN CAST(-sign(over_) AS BIGINT) ELSE 0 END AS {seats}
      FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY key_ DESC NULLS LAST, place) AS place_
            FROM (SELECT *, sum({seats}) OVER (PARTITION BY {group}) - house AS over_, {key} AS key_ FROM {table}))"""


def mix(block: int = mixing.BLOCK_WORDS, shard: int = mixing.SHARD_WORDS, seed: int = mixing.SEED) -> str:
    times = mixing.MOST_TIMES
    weights = "[" + ", ".join(f"CAST({w} AS DOUBLE)" for w in mixing.WEIGHTS) + "]"
    return f"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS n,
                      md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS mark FROM documents),
    s AS (SELECT source, CAST(sum(n) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
    w AS (SELECT *, {weights}[(place - 1) % {len(mixing.WEIGHTS)} + 1] AS wt, CAST({times} * source_size AS DOUBLE) AS cap FROM s),
    l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
                 sum(wt) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_,
                 CAST(sum(source_size) OVER () AS DOUBLE) * {mixing.TOTAL_SHARE} AS total FROM w),
    v AS (SELECT *, max(CASE WHEN (total - full_) / open_ * wt <= cap THEN (total - full_) / open_ END) OVER () AS level FROM l),
    t AS (SELECT source, place, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * wt) END AS target,
                 greatest(CAST(ceil(source_size / {shard}) AS BIGINT), 1) AS shards FROM v),
    p AS (SELECT d.*, t.* EXCLUDE (source), CAST('0x' || substr(mark, 1, 8) AS BIGINT) % shards AS sh FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
    c AS (SELECT place AS src, sh AS place, any_value(source_size) AS source_size, any_value(target) AS target, CAST(sum(n) AS BIGINT) AS size,
                 CAST(ceil(sum(n) / {block}) AS BIGINT) AS blocks, {times} * CAST(ceil(sum(n) / {block}) AS BIGINT) AS most FROM p GROUP BY place, sh),
    a AS (SELECT src AS place, 0 AS everything, any_value(target) AS target, any_value(source_size) AS source_size, CAST(sum(most) AS BIGINT) AS most,
                 least(CAST(floor(any_value(target) / {block}.0 + 0.5) AS BIGINT), CAST(sum(most) AS BIGINT)) AS seats FROM c GROUP BY src),
    h AS (SELECT *, CAST(floor(sum(source_size) OVER () * {mixing.TOTAL_SHARE} / {block}.0 + 0.5) AS BIGINT) AS house FROM a),
    seated AS ({_settled('h', 'everything', 'target', 'seats')}),
    q AS (SELECT c.*, seated.seats AS house, coalesce(least(CAST(floor(size / CASE WHEN seated.seats > 0 THEN c.source_size / seated.seats END + 0.5) AS BIGINT), c.most), 0) AS quota
          FROM c JOIN seated ON seated.place = c.src),
    quotas AS ({_settled('q', 'src', 'size', 'quota')}),
    stream AS (SELECT *, row_number() OVER () AS rid, sum(n) OVER (PARTITION BY place, sh ORDER BY mark, doc_id NULLS FIRST, n ROWS UNBOUNDED PRECEDING) AS e FROM p),
    parts AS (SELECT rid, unnest(range(CAST(floor((e - n) / {block}) AS BIGINT), CAST(floor((e - 1) / {block}) AS BIGINT) + 1)) AS b FROM stream WHERE n > 0),
    taken AS (SELECT rid, sum((least((b + 1) * {block}, e) - greatest(b * {block}, e - n))
                * (quota // blocks + CASE WHEN (b * {mixing.STRIDE} + {seed}) % blocks < quota % blocks THEN 1 ELSE 0 END)) AS k
              FROM parts JOIN stream USING (rid) JOIN quotas ON quotas.src = stream.place AND quotas.place = stream.sh GROUP BY rid)
    SELECT doc_id, n AS size, source_size, target, CAST(coalesce(k, 0) AS BIGINT) AS taken FROM stream LEFT JOIN taken USING (rid)"""


def _descent(tree: sharding.Tree) -> str:
    """(rid, shard): one level after another, the child with the smallest draw."""
    nodes = ", ".join(f"({quoted(path)}, {quoted(f'{path}/{name}')}, {weight!r}::DOUBLE)" for path, held in tree.children().items() for name, weight in held)
    digits = sharding.HASH_DIGITS
    draw = f"-ln((('0x' || substr(md5(key || ':' || n.path), 1, {digits}))::BIGINT + 0.5) / {float(16 ** digits)!r}) / n.weight"
    step = lambda source, at: (f"SELECT rid, key, min({{'draw': {draw}, 'path': n.path}}).path AS node "  # noqa: E731
                               f"FROM {source} JOIN nodes n ON n.parent = {at} GROUP BY rid, key")
    return f"""
    (WITH nodes(parent, path, weight) AS (VALUES {nodes}),
     region AS ({step('(SELECT rid, key FROM m)', "''")}), rack AS ({step('region', 'node')}), shard AS ({step('rack', 'node')})
     SELECT rid, split_part(node, '/', 4)::INTEGER AS shard FROM shard)"""


def sharding_places() -> str:
    """The checksum goes byte by byte through the table of the reflected polynomial, which the first CTE builds."""
    shift = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    steps = []
    for bit in range(8):
        steps.append(f"t{bit} AS (SELECT i, {shift.format('c')} AS c FROM {'(SELECT i, i AS c FROM range(256) r(i))' if bit == 0 else f't{bit - 1}'})")
    table = ", ".join(steps)
    return f"""
    WITH {table}, crc AS (SELECT list(c ORDER BY i) AS tab FROM t7),
    d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
    c AS (SELECT rid, xor(list_reduce([('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(b), '..')],
                 lambda acc, x: xor(acc >> 8, tab[1 + (xor(acc, x) & 255)]), 4294967295), 4294967295) AS text_crc32 FROM d, crc),
    m AS (SELECT rid, doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, octet_length(b) + {sharding.ROW_BYTES} AS size, text_crc32 FROM d JOIN c USING (rid)),
    now AS {_descent(sharding.layout())},
    grown AS {_descent(sharding.layout(added=1))}
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, now.shard,
           row_number() OVER (PARTITION BY now.shard ORDER BY md5(key || ':' || size || ':' || text_crc32), rid) - 1 AS slot, grown.shard AS grown_shard
    FROM m JOIN now USING (rid) JOIN grown USING (rid)"""


def _finite(column: str) -> str:
    return f"{column} IS NOT NULL AND len([x FOR x IN {column} IF x IS NULL OR NOT isfinite(x)]) = 0"


def _whole(column: str) -> str:
    return f"[greatest(-{codes.LARGEST}, least({codes.LARGEST}, floor({codes.SCALE} * x::DOUBLE)))::BIGINT FOR x IN {column}]"


def vector_codes(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS) -> str:
    away = "list_sum([z[1] * z[1] FOR z IN list_transform(list_zip(p.x, c.x), lambda z: [z[1] - z[2]])])"
    nearest = lambda r: f"""
    a{r} AS (SELECT rid, part, one.d AS d, one.entry AS entry FROM (
       SELECT p.rid, p.part, min({{'d': {away}, 'entry': c.entry}}) AS one FROM p JOIN c{r} c ON c.part = p.part GROUP BY p.rid, p.part))"""  # noqa: E731
    steps = [nearest(0)]
    for r in range(rounds):
        steps.append(f"""
    s{r} AS (SELECT part, entry, list(v ORDER BY i) AS x FROM (
       SELECT part, entry, i, floor(sum(v) / count(*))::BIGINT AS v FROM (
         SELECT p.part, a.entry, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS i FROM p JOIN a{r} a ON a.rid = p.rid AND a.part = p.part) GROUP BY part, entry, i)
       GROUP BY part, entry),
    c{r + 1} AS (SELECT c.part, c.entry, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN s{r} s ON s.part = c.part AND s.entry = c.entry)""")
        steps.append(nearest(r + 1))
    return f"""
    WITH e AS (SELECT row_number() OVER () AS rid, vec_id, label, {_whole('embedding')} AS v FROM embeddings WHERE {_finite('embedding')}),
    p AS (SELECT rid, vec_id, part::INTEGER AS part, v[(part * len(v) // {parts}) + 1 : (part + 1) * len(v) // {parts}] AS x FROM e, range({parts}) r(part)),
    c0 AS (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1)::INTEGER AS entry, x FROM p QUALIFY entry < {entries}),
    {','.join(steps)},
    books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM c{rounds}),
    coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM books) AS codebooks_sha256
    FROM e JOIN coded USING (rid)"""


def hard_negatives() -> str:
    return f"""
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_whole('embedding')}::DOUBLE[] AS v
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_finite('embedding')}),
    scored AS (SELECT a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS alike, list_inner_product(a.v, e.v)::BIGINT AS score
               FROM e a JOIN e ON e.vec_id <> a.vec_id WHERE a.vec_id % {negatives.ANCHORS_EVERY} = 0),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES})
    SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
    FROM positives JOIN scored s USING (anchor_id)
    WHERE NOT s.alike AND {negatives.LOW} * positive_score <= {negatives.OF} * s.score AND {negatives.OF} * s.score <= {negatives.HIGH} * positive_score
    WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
    QUALIFY row_number() OVER best <= {negatives.NEGATIVES}"""
