"""DuckDB SQL for the queries that SQL can express. Each stands for the query of its name in ``queries``."""

from __future__ import annotations

#: The same parameters as in ``queries``.
MASK, SECOND_MASK, K = "111101111011101111", "1111111111111111", 8
ONE_WAY_MASK = "1101011011101"
#: Masks of rising sets: wide ones, and one that nearly all near places fit.
ACCURATE = ["1" * 24, "11011011011011011011011011", "1111011110111101111"]

CYCLE = "acgtacgtacgtacgtacgtacgtac"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def encoded(column: str) -> str:
    return f"translate(lower(regexp_replace({column}, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{CYCLE}')"


def cased(column: str) -> str:
    return f"translate(regexp_replace({column}, '[^A-Za-z]', '', 'g'), '{LETTERS}{LETTERS.upper()}', '{CYCLE}{CYCLE.upper()}')"


def runs(mask: str) -> list[tuple[int, int]]:
    """Start and length of each run of 1s."""
    out, at = [], 0
    while at < len(mask):
        end = at
        while end < len(mask) and mask[end] == mask[at]:
            end += 1
        if mask[at] == "1":
            out.append((at, end - at))
        at = end
    return out


def key(mask: str, seq: str = "seq", pos: str = "pos") -> str:
    """The key of the window at ``pos`` (from 1)."""
    return " || ".join(f"substr({seq}, ({pos} + {a})::BIGINT, {n})" for a, n in runs(mask))


REF = f"ref AS MATERIALIZED (SELECT doc_id AS contig, {encoded('text')} AS seq FROM documents)"
READS = f"reads AS MATERIALIZED (SELECT item_id AS read_id, 1 AS end_no, {encoded('text')} AS seq FROM benchmark)"
TURN = "translate(reverse({}), 'acgt', 'tgca')"


def seeds(mask: str, name: str = "idx", ref: str = "ref") -> str:
    w = len(mask)
    return (
        f"{name}_w AS (SELECT contig, seq, unnest(range(1, length(seq) - {w} + 2)) AS pos FROM {ref} WHERE length(seq) >= {w}), "
        f"{name} AS MATERIALIZED (SELECT contig, pos, {key(mask)} AS key FROM {name}_w)"
    )


def read_keys(mask: str, name: str = "rk", reads: str = "reads") -> str:
    w = len(mask)
    return (
        f"{name}_w AS (SELECT read_id, end_no, length(seq) AS len, unnest(range(0, length(seq) - {w} + 1)) AS off, seq FROM {reads} WHERE length(seq) >= {w}), "
        f"{name}_t AS (SELECT read_id, end_no, len, off, seq, {TURN.format(f'substr(seq, (off + 1)::BIGINT, {w})')} AS back FROM {name}_w), "
        f"{name} AS MATERIALIZED (SELECT read_id, end_no, len, off, '+' AS strand, {key(mask, 'seq', '(off + 1)')} AS key FROM {name}_t "
        f"UNION ALL SELECT read_id, end_no, len, off, '-', {key(mask, 'back', '1')} FROM {name}_t)"
    )


def matching(mask: str = MASK, tag: str = "", reads: str = "reads", k: int = K, most: int = 384, keys: str = "", forward: int = 0) -> str:
    """Tables cals and ends, with ``tag`` after their names. ``keys``: other SQL for the tables of seeds and of read keys; ``forward``: what forward places lose."""
    i, r, w = f"idx{tag}", f"rk{tag}", len(mask)
    return f"""{keys or f"{seeds(mask, i)}, {read_keys(mask, r, reads)}"},
freq{tag} AS (SELECT key, count(*) AS n FROM {i} GROUP BY key),
hits{tag} AS MATERIALIZED (SELECT {r}.*, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY read_id, end_no, off) AS hits FROM {r} LEFT JOIN freq{tag} USING (key)),
flag{tag} AS (SELECT read_id, end_no, count(*) FILTER (hits > {k}) AS missed, count(*) AS keys FROM (SELECT DISTINCT read_id, end_no, off, hits FROM hits{tag}) GROUP BY ALL),
placed{tag} AS MATERIALIZED (SELECT h.read_id, h.end_no, h.len, h.off, h.strand, i.contig,
   CASE WHEN h.strand = '+' THEN i.pos - h.off - {forward} ELSE i.pos + {w} + h.off - h.len END AS position
   FROM hits{tag} h JOIN {i} i USING (key) WHERE h.hits <= {k}),
u{tag} AS MATERIALIZED (SELECT read_id, end_no, contig, position, strand, max(len) AS len, list_sort(list(DISTINCT off)) AS offsets FROM placed{tag} GROUP BY read_id, end_no, contig, position, strand),
ends{tag} AS MATERIALIZED (SELECT f.read_id, f.end_no, f.missed, f.keys, CASE WHEN coalesce(c.n, 0) > {most} THEN -1 ELSE trunc(255 * (missed::DOUBLE / keys))::INT END AS max_reached, coalesce(c.n, 0) AS n
   FROM flag{tag} f LEFT JOIN (SELECT read_id, end_no, count(*) AS n FROM u{tag} GROUP BY ALL) c ON f.read_id = c.read_id AND f.end_no = c.end_no),
cals{tag} AS MATERIALIZED (SELECT u{tag}.* FROM u{tag} SEMI JOIN (SELECT * FROM ends{tag} WHERE max_reached >= 0) e USING (read_id, end_no))"""


def mask_text(mask: str) -> str:
    """The mask of a candidate's offsets, in read order."""
    own = f"CASE WHEN strand = '-' THEN '{mask[::-1]}' ELSE '{mask}' END"
    covered = f"len([1 FOR o IN offsets IF p >= o AND p < o + {len(mask)} AND substr({own}, (p - o + 1)::BIGINT, 1) = '1']) > 0"
    return f"array_to_string([CASE WHEN {covered} THEN '1' ELSE '0' END FOR p IN range(len)], '')"


SCORED = f"""{REF}, {READS}, {matching()},
a AS MATERIALIZED (SELECT read_id, end_no, contig, position::BIGINT AS position, strand, (50 * len(offsets) - 400)::INT AS score, len FROM cals)"""

HALVES = f"""halves AS MATERIALIZED (SELECT item_id AS read_id, 1 AS end_no, substr({encoded('text')}, 1, 40) AS seq FROM benchmark WHERE length({encoded('text')}) >= 80
  UNION ALL SELECT item_id, 2, right({encoded('text')}, 40) FROM benchmark WHERE length({encoded('text')}) >= 80)"""
PAIRED = f"""{REF}, {HALVES}, {matching(SECOND_MASK, '', 'halves', 64)},
a AS MATERIALIZED (SELECT read_id, end_no, contig, position::BIGINT AS position, strand, (50 * len(offsets) - 400)::INT AS score FROM cals)"""
UNIQUE = "b AS (SELECT * FROM (SELECT *, rank() OVER w AS r, count(*) OVER (PARTITION BY read_id, end_no, score) AS same FROM a WINDOW w AS (PARTITION BY read_id, end_no ORDER BY score DESC)) WHERE r = 1 AND same = 1)"
BOTH = "p AS (SELECT x.read_id, x.contig AS contig_1, x.position AS position_1, x.strand AS strand_1, x.score AS score_1, y.contig AS contig_2, y.position AS position_2, y.strand AS strand_2, y.score AS score_2 FROM {0} x JOIN {0} y ON x.read_id = y.read_id AND x.end_no = 1 AND y.end_no = 2)"
AHEAD = "CASE WHEN strand_1 = '+' THEN position_2 - position_1 ELSE position_1 - position_2 END"
#: The error function's complement as in ``select.erfc``, of z / sqrt(2).
Z = f"CASE WHEN strand_1 <> strand_2 OR contig_1 <> contig_2 THEN 3.0::DOUBLE ELSE least(abs(({AHEAD})::DOUBLE - 100.0::DOUBLE) / 50.0::DOUBLE, 3.0::DOUBLE) END"
T = "(1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * x))"
ERFC = f"((((1.061405429::DOUBLE * {T} + -1.453152027::DOUBLE) * {T} + 1.421413741::DOUBLE) * {T} + -0.284496736::DOUBLE) * {T} + 0.254829592::DOUBLE) * {T} * exp(-x * x)"
PAIRS = f"""{PAIRED}, {BOTH.format('a')}, z AS (SELECT *, ({Z}) * sqrt(0.5::DOUBLE) AS x FROM p),
ps AS MATERIALIZED (SELECT read_id, contig_1, position_1, strand_1, score_1, contig_2, position_2, strand_2, score_2, (score_1 + score_2 - trunc(200 * -log10({ERFC}) + 0.499::DOUBLE)::INT)::INT AS pair_score FROM z)"""

COLOR_MASK = "11110111101111"
#: Colours: a place's against the one before it, A before the first; a reference's seeds and a read's keys are cut from these strings.
COLORS = "array_to_string([xor(strpos('acgt', substr({0}, (i + 1)::BIGINT, 1)) - 1, CASE WHEN i = 0 THEN 0 ELSE strpos('acgt', substr({0}, i::BIGINT, 1)) - 1 END) FOR i IN range(length({0}))], '')"
COLOR_REF = f"cref AS MATERIALIZED (SELECT contig, {COLORS.format('seq')} AS seq FROM ref)"


def color_keys(mask: str = COLOR_MASK) -> str:
    """idx and rk in colours. Reads are colours from base A; the first is left out, so the window at offset o begins with colour o + 2."""
    w = len(mask)
    return (
        f"{COLOR_REF}, {seeds(mask, 'idx', 'cref')}, creads AS MATERIALIZED (SELECT read_id, end_no, length(seq) AS len, substr({COLORS.format('seq')}, 2) AS seq FROM reads), "
        f"rk_w AS (SELECT read_id, end_no, len, unnest(range(0, length(seq) - {w} + 1)) AS off, seq FROM creads WHERE length(seq) >= {w}), "
        f"rk_t AS (SELECT *, reverse(substr(seq, (off + 1)::BIGINT, {w})) AS back FROM rk_w), "
        f"rk AS MATERIALIZED (SELECT read_id, end_no, len, off, '+' AS strand, {key(mask, 'seq', '(off + 1)')} AS key FROM rk_t UNION ALL SELECT read_id, end_no, len, off, '-', {key(mask, 'back', '1')} FROM rk_t)"
    )


COLORED = f"{REF}, {READS}, {matching(COLOR_MASK, keys=color_keys(), forward=1)}"

ORACLES: dict[str, str] = {
    "encode_reference": "SELECT doc_id AS contig, length(s)::INT AS length, md5(s) AS digest FROM (SELECT doc_id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'UuRYMKWSBDHVrymkwsbdhv', 'TtNNNNNNNNNNnnnnnnnnnn') AS s FROM documents)",
    "reverse_complement": f"WITH {READS} SELECT read_id, {TURN.format('seq')} AS turned FROM reads",
    "color_reads": f"WITH {READS} SELECT read_id, array_to_string([xor(strpos('acgt', substr(seq, (i + 1)::BIGINT, 1)) - 1, CASE WHEN i = 0 THEN 0 ELSE strpos('acgt', substr(seq, i::BIGINT, 1)) - 1 END) FOR i IN range(length(seq))], '') AS colors FROM reads",
    "decode_colors": f"WITH {READS} SELECT read_id, upper(seq) AS bases FROM reads",
    "header": f"WITH {REF} SELECT count(*) AS contigs, sum(length(seq))::BIGINT AS bases FROM ref",
    "sam_header": f"WITH {REF} SELECT contig AS n, '@SQ' || chr(9) || 'SN:contig' || contig || chr(9) || 'LN:' || length(seq) AS line FROM ref UNION ALL SELECT -(1::BIGINT << 62), '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unsorted' UNION ALL SELECT (1::BIGINT << 62) + 1, '@PG' || chr(9) || 'ID:seedloom' || chr(9) || 'VN:1'",
    "end_grouping": """WITH t AS (SELECT conv_id % 8 AS lane, conv_id AS name, turn, text FROM conversations),
g AS (SELECT *, sum(new) OVER (PARTITION BY lane ORDER BY name, turn)::BIGINT AS "group" FROM (SELECT *, CASE WHEN lag(name) OVER (PARTITION BY lane ORDER BY name, turn) = name THEN 0 ELSE 1 END AS new FROM t))
SELECT lane, name, turn, "group", row_number() OVER (PARTITION BY lane, "group" ORDER BY name, turn)::INT AS end_no FROM g""",
    "read_subrange": "SELECT item_id, n FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM benchmark) WHERE n BETWEEN 5 AND 25",
    "seed_scan": f"WITH {REF}, {seeds(MASK)} SELECT substr(key, 1, 3) AS prefix, count(*) AS seeds, count(DISTINCT key) AS keys, min(pos)::INT AS first, max(pos)::INT AS last FROM idx GROUP BY ALL",
    "repeat_seeds": f"WITH cref AS MATERIALIZED (SELECT page_id AS contig, {cased('html')} AS seq FROM pages), {seeds('11101', 'idx', 'cref')} SELECT contig, count(*) AS seeds FROM idx WHERE NOT regexp_matches(key, '[a-z]') GROUP BY contig",
    "seed_bins": f"WITH {REF}, {seeds(MASK)} SELECT (4 * (strpos('acgt', substr(key, 1, 1)) - 1) + strpos('acgt', substr(key, 2, 1)) - 1)::INT AS bin, count(*) AS seeds FROM idx GROUP BY ALL",
    "exon_seeds": f"WITH {REF}, {seeds(MASK)}, x AS (SELECT contig, length(seq) // 4 + 1 AS s, length(seq) // 2 AS e FROM ref) SELECT idx.contig, count(*) AS seeds FROM idx JOIN x ON idx.contig = x.contig AND pos >= s AND pos + {len(MASK)} - 1 <= e GROUP BY idx.contig",
    "region_seeds": f"WITH {REF}, {seeds(MASK)} SELECT contig, count(*) AS seeds FROM idx WHERE (contig > 10 OR (contig = 10 AND pos >= 100)) AND (contig < 90 OR (contig = 90 AND pos + {len(MASK)} - 1 <= 500)) GROUP BY contig",
    "truncated_keys": f"WITH {REF}, {seeds('11110111101')} SELECT key, count(*) AS seeds FROM idx GROUP BY key",
    "key_counts": f"WITH {REF}, {seeds(MASK)} SELECT times, count(*) AS keys FROM (SELECT key, count(*) AS times FROM idx GROUP BY key) GROUP BY times",
    "seed_join": f"WITH {REF}, {READS}, {matching()} SELECT read_id, end_no, contig, position::INT AS position, strand, len(offsets)::INT AS seeds FROM cals",
    "end_flags": f"WITH {REF}, {READS}, {matching(k=2, most=4)} SELECT read_id, end_no, missed, keys, max_reached, (CASE WHEN max_reached < 0 THEN 0 ELSE n END)::BIGINT AS cals FROM ends",
    "cal_masks": f"WITH {REF}, {READS}, {matching()} SELECT read_id, end_no, contig, position::INT AS position, strand, {mask_text(MASK)} AS mask FROM cals",
    "merged_indexes": f"""WITH {REF}, {READS}, {matching()}, {matching(SECOND_MASK, '2')},
m AS (SELECT read_id, end_no, contig, position, strand, len, {mask_text(MASK)} AS mask FROM cals UNION ALL SELECT read_id, end_no, contig, position, strand, len, {mask_text(SECOND_MASK)} FROM cals2)
SELECT read_id, end_no, contig, position::INT AS position, strand, array_to_string([CASE WHEN len([1 FOR x IN masks IF substr(x, (p + 1)::BIGINT, 1) = '1']) > 0 THEN '1' ELSE '0' END FOR p IN range(len)], '') AS mask
FROM (SELECT read_id, end_no, contig, position, strand, max(len) AS len, list(DISTINCT mask) AS masks FROM m GROUP BY read_id, end_no, contig, position, strand)""",
    "secondary_fallback": f"""WITH {REF}, {READS}, {matching(SECOND_MASK)}, more AS (SELECT * FROM reads WHERE read_id NOT IN (SELECT read_id FROM cals)), {matching('1111011101111', '2', 'more')}
SELECT read_id, end_no, contig, position::INT AS position, strand, 'main' AS found FROM cals UNION ALL SELECT read_id, end_no, contig, position::INT, strand, 'secondary' FROM cals2""",
    "merged_bins": f"""WITH {REF}, {READS}, {matching()}, n AS (SELECT *, count(*) OVER (PARTITION BY read_id, end_no, off) AS c FROM placed)
SELECT read_id, end_no, contig, position::INT AS position, strand, count(DISTINCT off)::INT AS seeds FROM n WHERE c <= 2 GROUP BY read_id, end_no, contig, position, strand""",
    "cals_in_range": f"WITH {REF}, {READS}, {matching()} SELECT read_id, contig, position::INT AS position, strand FROM cals WHERE (contig > 100 OR (contig = 100 AND position >= 1)) AND (contig < 400 OR (contig = 400 AND position <= 1000))",
    "reference_windows": f"""WITH {REF}, {READS}, {matching()}, w AS (SELECT cals.*, greatest(position - 20, 1) AS lo FROM cals)
SELECT read_id, w.contig, position::INT AS position, strand, CASE WHEN strand = '-' THEN {TURN.format('f')} ELSE f END AS "window"
FROM (SELECT w.*, substr(seq, lo::BIGINT, (position + len + 20 - lo)::BIGINT) AS f FROM w JOIN ref ON w.contig = ref.contig) w""",
    "exact_matches": f"""WITH {REF}, {READS}, {matching()}
SELECT c.read_id, c.contig, c.position::INT AS position, c.strand FROM cals c JOIN ref ON c.contig = ref.contig JOIN reads r ON c.read_id = r.read_id
WHERE c.position >= 1 AND CASE WHEN c.strand = '-' THEN {TURN.format('substr(ref.seq, c.position::BIGINT, c.len)')} ELSE substr(ref.seq, c.position::BIGINT, c.len) END = r.seq""",
    "mirrored_cals": f"""WITH {PAIRED}, o AS (SELECT read_id, 3 - end_no AS end_no, contig, position + (CASE WHEN strand = '+' THEN 40 ELSE -40 END) * (CASE WHEN end_no = 1 THEN 1 ELSE -1 END) AS position, strand, true AS implied FROM cals)
SELECT read_id, end_no, contig, position::INT AS position, strand, bool_and(implied) AS implied FROM (SELECT read_id, end_no, contig, position, strand, false AS implied FROM cals UNION ALL SELECT * FROM o) WHERE position > 0 GROUP BY read_id, end_no, contig, position, strand""",
    "mapping_quality": f"""WITH {SCORED}, s AS (SELECT *, max(score) OVER e AS best FROM a WINDOW e AS (PARTITION BY read_id, end_no)),
t AS (SELECT *, max(CASE WHEN score < best THEN score END) OVER e AS nxt FROM s WINDOW e AS (PARTITION BY read_id, end_no)),
counted AS (SELECT *, count(*) FILTER (score = best) OVER e AS n1, count(*) FILTER (score = nxt) OVER e AS n2 FROM t WINDOW e AS (PARTITION BY read_id, end_no)),
v AS (SELECT *, CASE WHEN nxt IS NULL THEN CASE WHEN best < 0 THEN best - 1 ELSE 0 END WHEN best > 0 THEN greatest(nxt, 0) ELSE nxt END AS second FROM counted),
q AS (SELECT *, 0.2::DOUBLE * 1.0::DOUBLE * (250.0::DOUBLE / (50.0::DOUBLE * len)) * (n1::DOUBLE / (CASE WHEN nxt IS NULL THEN 1 ELSE n2 END)) * (best - second + 1) AS q FROM v)
SELECT read_id, contig, position, strand, score, (CASE WHEN score < best OR n1 > 1 THEN 0 ELSE least(greatest(trunc(q + 0.99999::DOUBLE)::INT, 1), 255) END)::INT AS mapq FROM q""",
    "unique_alignments": f"WITH {SCORED} SELECT read_id, contig, position, strand FROM (SELECT *, count(*) OVER (PARTITION BY read_id, end_no) AS n FROM a) WHERE n = 1",
    "unique_best": f"WITH {SCORED}, {UNIQUE} SELECT read_id, contig, position, strand, score FROM b",
    "all_best": f"WITH {SCORED} SELECT read_id, contig, position, strand, score FROM (SELECT *, max(score) OVER (PARTITION BY read_id, end_no) AS best FROM a) WHERE score = best",
    "score_filter": f"WITH {SCORED} SELECT read_id, contig, position, strand FROM a WHERE trunc(score::DOUBLE / len)::INT >= 10",
    "mapped_ends": f"WITH {PAIRED}, {UNIQUE} SELECT mapped, count(*) AS reads FROM (SELECT h.read_id, count(b.end_no) AS mapped FROM halves h LEFT JOIN b ON h.read_id = b.read_id AND h.end_no = b.end_no GROUP BY h.read_id) GROUP BY mapped",
    "pair_distances": f"WITH {PAIRED}, {UNIQUE}, {BOTH.format('b')} SELECT read_id, ({AHEAD})::BIGINT AS distance FROM p WHERE contig_1 = contig_2 AND strand_1 = strand_2 AND abs({AHEAD}) <= 20000",
    "insert_size": f"WITH {PAIRED}, {UNIQUE}, {BOTH.format('b')}, d AS (SELECT {AHEAD} AS d FROM p WHERE contig_1 = contig_2 AND strand_1 = strand_2 AND abs({AHEAD}) <= 20000) SELECT count(*) AS n, avg(d) AS mean, min(d)::BIGINT AS least, max(d)::BIGINT AS most FROM d",
    "pair_scores": f"WITH {PAIRS} SELECT read_id, contig_1, position_1, strand_1, contig_2, position_2, strand_2, pair_score FROM ps",
    "proper_pairs": f"WITH {PAIRED}, {BOTH.format('a')} SELECT read_id, contig_1, position_1, strand_1, contig_2, position_2, strand_2, contig_1 = contig_2 AND strand_1 = strand_2 AND ({AHEAD}) BETWEEN 0 AND 250 AS proper FROM p",
    "best_pairs": f"""WITH {PAIRS}, b1 AS (SELECT *, max(pair_score) OVER (PARTITION BY read_id) AS top FROM ps),
b2 AS (SELECT *, max(CASE WHEN pair_score < top THEN pair_score END) OVER (PARTITION BY read_id) AS nxt FROM b1),
b3 AS (SELECT *, count(*) FILTER (pair_score = top) OVER (PARTITION BY read_id) AS n1, count(*) FILTER (pair_score = nxt) OVER (PARTITION BY read_id) AS n2 FROM b2)
SELECT read_id, contig_1, position_1, strand_1, contig_2, position_2, strand_2, pair_score,
  greatest(least(trunc(0.2::DOUBLE * 250.0::DOUBLE / (50 * 40) / (CASE WHEN nxt IS NULL THEN 1 ELSE n2 END) * (pair_score - coalesce(nxt, score_2) + 1) + 0.99999::DOUBLE)::INT, 255), 1)::INT AS mapq
FROM b3 WHERE pair_score = top AND n1 = 1""",
    "random_best": f"""WITH {SCORED}, b AS (SELECT *, max(score) OVER (PARTITION BY read_id, end_no) AS best FROM a),
c AS (SELECT *, count(*) OVER (PARTITION BY read_id, end_no) AS same, row_number() OVER (PARTITION BY read_id, end_no ORDER BY md5('0 ' || read_id || ' ' || end_no || ' ' || contig || ' ' || position || ' ' || strand), contig, position, strand) AS pick FROM b WHERE score = best)
SELECT read_id, contig, position, strand, score, (CASE WHEN same > 1 THEN 0 ELSE 1 END)::INT AS mapq FROM c WHERE pick = 1""",
    "one_strand": f"""WITH {REF}, {READS}, {seeds(MASK)}, {read_keys(MASK)}, f AS (SELECT key, count(*) AS n FROM idx GROUP BY key),
h AS (SELECT rk.* FROM rk JOIN f USING (key) WHERE strand = '-' AND n <= {K})
SELECT read_id, end_no, contig, (pos + {len(MASK)} + off - len)::INT AS position, '-' AS strand, count(DISTINCT off)::INT AS seeds FROM h JOIN idx USING (key) GROUP BY ALL""",
    "color_seed_scan": f"WITH {REF}, {COLOR_REF}, {seeds(COLOR_MASK, 'idx', 'cref')} SELECT substr(key, 1, 3) AS prefix, count(*) AS seeds, count(DISTINCT key) AS keys, min(pos)::INT AS first, max(pos)::INT AS last FROM idx GROUP BY ALL",
    "color_seed_join": f"WITH {COLORED} SELECT read_id, end_no, contig, position::INT AS position, strand, len(offsets)::INT AS seeds FROM cals",
    "color_cal_masks": f"WITH {COLORED}, x AS (SELECT read_id, end_no, contig, position, strand, len, [o + 1 FOR o IN offsets] AS offsets FROM cals) SELECT read_id, end_no, contig, position::INT AS position, strand, {mask_text(COLOR_MASK)} AS mask FROM x",
    "color_exact": f"""WITH {COLORED}
SELECT c.read_id, c.contig, c.position::INT AS position, c.strand FROM cals c JOIN ref ON c.contig = ref.contig JOIN reads r ON c.read_id = r.read_id
WHERE c.position >= 1 AND CASE WHEN c.strand = '-' THEN {TURN.format('substr(ref.seq, c.position::BIGINT, c.len)')} ELSE substr(ref.seq, c.position::BIGINT, c.len) END = r.seq""",
    "tandem_repeats": f"""WITH {REF}, s AS MATERIALIZED (SELECT contig, seq, length(seq) AS n FROM ref),
ch AS MATERIALIZED (SELECT contig, i, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3, lead(c, 4) OVER w AS c4, lead(c, 5) OVER w AS c5, lead(c, 6) OVER w AS c6
  FROM (SELECT contig, unnest(range(1, n + 1)) AS i, unnest(string_split(seq, '')) AS c FROM s WHERE n > 0) WINDOW w AS (PARTITION BY contig ORDER BY i)),
eq AS (SELECT contig, 1 AS u, i FROM ch WHERE c = c1 UNION ALL SELECT contig, 2, i FROM ch WHERE c = c2 UNION ALL SELECT contig, 3, i FROM ch WHERE c = c3
  UNION ALL SELECT contig, 4, i FROM ch WHERE c = c4 UNION ALL SELECT contig, 5, i FROM ch WHERE c = c5 UNION ALL SELECT contig, 6, i FROM ch WHERE c = c6),
isl AS (SELECT contig, u, i, i - row_number() OVER (PARTITION BY contig, u ORDER BY i) AS g FROM eq),
run AS (SELECT contig, u, i, max(i) OVER (PARTITION BY contig, u, g) - i + 1 AS ahead FROM isl),
own AS (SELECT contig, u, i, u * (1 + ahead // u) AS len FROM run WHERE u * (1 + ahead // u) >= 12 AND u * (1 + ahead // u) > u),
best AS (SELECT contig, i, arg_min(u, len * -10 + u) AS u, max(len) AS len FROM own GROUP BY contig, i),
prev AS (SELECT *, lag(i) OVER w AS pi, lag(u) OVER w AS pu, lag(len) OVER w AS pl FROM best WINDOW w AS (PARTITION BY contig ORDER BY i))
SELECT prev.contig, i::BIGINT AS start, (i + len - 1)::BIGINT AS stop, len::BIGINT AS length, u::INT AS unit_length, substr(seq, i::BIGINT, u::BIGINT) AS unit
FROM prev JOIN s ON prev.contig = s.contig WHERE pi IS NULL OR (NOT (i = pi + 1 AND u = pu AND len = pl) AND i + len - 1 > pi + pl - 1)""",
    "score_distribution": f"WITH {SCORED} SELECT n_cals, (trunc((least(greatest(score, -2000), 2000) + 2000)::DOUBLE / 10))::INT AS bucket, count(*) AS alignments FROM (SELECT *, count(*) OVER (PARTITION BY read_id, end_no) AS n_cals FROM a) GROUP BY ALL",
    "key_distribution": f"WITH {REF}, {seeds('111111')}, n AS (SELECT key, count(*) AS forward FROM idx GROUP BY key) SELECT n.key, n.forward, n.forward + CASE WHEN n.key = {TURN.format('n.key')} THEN 0 ELSE coalesce(m.forward, 0) END AS both FROM n LEFT JOIN n m ON m.key = {TURN.format('n.key')}",
    "key_histogram": f"WITH {REF}, {seeds('111111111111')} SELECT times, count(*) AS keys FROM (SELECT least(key, {TURN.format('key')}) AS k, count(*) AS times FROM idx GROUP BY ALL) GROUP BY times",
    "accuracy": f"""WITH {REF}, {READS.replace('reads AS', 'unused AS')}, reads AS MATERIALIZED (SELECT read_id, 1 AS end_no, contig AS tc, tp, ts, CASE WHEN ts = '-' THEN {TURN.format('f')} ELSE f END AS seq
  FROM (SELECT contig AS read_id, contig, 1 + (contig * 7919) % (length(seq) - 60) AS tp, CASE WHEN contig % 2 = 0 THEN '+' ELSE '-' END AS ts, substr(seq, (1 + (contig * 7919) % (length(seq) - 60))::BIGINT, 60) AS f FROM ref WHERE length(seq) > 60)), {matching(SECOND_MASK)},
o AS (SELECT r.read_id, r.ts, min(CASE WHEN c.contig = r.tc AND c.strand = r.ts THEN abs(c.position - r.tp) END) AS off, count(c.contig) AS n FROM reads r LEFT JOIN cals c ON r.read_id = c.read_id GROUP BY r.read_id, r.ts)
SELECT ts AS true_strand, count(*) AS reads, count(*) FILTER (n > 0) AS aligned, count(*) FILTER (off <= 0) AS within_0, count(*) FILTER (off <= 10) AS within_10, count(*) FILTER (off <= 100) AS within_100, count(*) FILTER (off <= 1000) AS within_1000, count(*) FILTER (off <= 10000) AS within_10000 FROM o GROUP BY ts""",
    "expected_hits": f"WITH {READS}, g AS (SELECT sum(length({encoded('text')}))::DOUBLE AS bases FROM documents) SELECT read_id, (length(seq) - 15 + 1) * bases / pow(4.0, 15) AS expected FROM reads, g",
    "index_size": f"WITH {REF} SELECT (CASE WHEN count(*) <= 256 THEN 5 ELSE 8 END * sum(length(seq)) + 4 * 4 ** 8)::BIGINT AS bytes FROM ref",
    "illumina_reads": f"WITH {READS} SELECT 'r' || read_id AS name, substr(seq, 1, 4) AS barcode, {TURN.format('substr(seq, 5)')} AS seq, reverse(repeat('I', (length(seq) - 4)::BIGINT)) AS qual FROM reads",
    "barcode_length": f"WITH {READS}, s AS (SELECT k, avg(CASE WHEN substr(seq, k, 1) = 't' THEN 1 ELSE 0 END) AS share FROM reads, range(2, 11) AS x(k) GROUP BY k) SELECT coalesce(max(CASE WHEN share > 0.2 THEN k END), 0)::INT AS length FROM s",
    "color_read_files": "SELECT 'bead_' || coalesce(b.item_id, q.item_id) AS name, b.item_id::VARCHAR AS seq, q.qual FROM (SELECT item_id FROM benchmark WHERE item_id % 3 <> 0) b FULL JOIN (SELECT item_id, chr((33 + item_id % 40)::INT) || '!' AS qual FROM benchmark WHERE item_id % 3 <> 1) q ON b.item_id = q.item_id",
    "mask_bits": "SELECT item_id, item_id AS bits, reverse(lpad(bin(item_id), 20, '0')) AS mask FROM benchmark",
    "sam_flags": """SELECT item_id, (CASE WHEN p THEN 1 + CASE WHEN pr THEN 2 ELSE 0 END + CASE WHEN NOT mm THEN 8 ELSE 0 END + CASE WHEN mm AND mr THEN 32 ELSE 0 END + CASE WHEN e = 1 THEN 64 ELSE 128 END ELSE 0 END
 + CASE WHEN NOT m THEN 4 ELSE 0 END + CASE WHEN m AND s THEN 256 ELSE 0 END + CASE WHEN m AND r THEN 16 ELSE 0 END)::INT AS flag
FROM (SELECT item_id, item_id % 2 = 1 AS p, item_id // 2 % 2 = 1 AS pr, item_id // 4 % 2 = 1 AS m, item_id // 8 % 2 = 1 AS mm, item_id // 16 % 2 = 1 AS r, item_id // 32 % 2 = 1 AS mr, 1 + item_id % 3 % 2 AS e, item_id % 5 = 0 AS s FROM benchmark)""",
    "seed_accuracy": """WITH m(n, mask) AS (VALUES (1, '111111111'), (2, '1101011011101'), (3, '11100101110011')), e AS (SELECT a.range AS a, b.range AS b, c.range AS c FROM range(30) a, range(30) b, range(30) c WHERE a.range < b.range AND b.range < c.range),
w AS (SELECT n, mask, unnest(range(0, 30 - length(mask) + 1)) AS o FROM m),
f AS (SELECT e.a, e.b, e.c, min(n) FILTER (coalesce(substr(mask, (a - o + 1)::BIGINT, CASE WHEN a >= o THEN 1 ELSE 0 END), '') <> '1' AND coalesce(substr(mask, (b - o + 1)::BIGINT, CASE WHEN b >= o THEN 1 ELSE 0 END), '') <> '1' AND coalesce(substr(mask, (c - o + 1)::BIGINT, CASE WHEN c >= o THEN 1 ELSE 0 END), '') <> '1') AS first FROM e, w GROUP BY e.a, e.b, e.c)
SELECT n AS masks, count(*) AS profiles, count(*) FILTER (first <= n) AS found FROM f, (SELECT n FROM m) GROUP BY n""",
}
ORACLES["match_stream"] = ORACLES["cal_masks"]
#: However the index is stored or split, the places are the same.
ORACLES["stored_index_join"] = ORACLES["seed_join"]
ORACLES["binned_join"] = f"""WITH {REF}, {READS}, {matching()} SELECT read_id, end_no, contig, position::INT AS position, strand, len(offsets)::INT AS seeds FROM u"""
ORACLES["end_grouping_whole"] = """WITH g AS (SELECT *, sum(new) OVER (ORDER BY name, turn)::BIGINT AS "group" FROM (SELECT conv_id AS name, turn, CASE WHEN lag(conv_id) OVER (ORDER BY conv_id, turn) = conv_id THEN 0 ELSE 1 END AS new FROM conversations))
SELECT name, turn, "group", row_number() OVER (PARTITION BY "group" ORDER BY turn)::INT AS end_no FROM g"""
NAMED = "'read_' || (read_id % 7) || '_' || read_id"
ORACLES["fastq_reads"] = f"WITH {READS} SELECT {NAMED} AS name, seq, translate(seq, 'acgt', 'I@+#') AS qual FROM reads"
ORACLES["split_reads"] = f"""WITH {READS}, o AS (SELECT {NAMED} AS name, row_number() OVER (ORDER BY read_id % 7, read_id) AS n FROM reads)
SELECT name, n, ((n - 1) // 30 + 1)::BIGINT AS file FROM o"""
#: Keys by a mask that doesn't read the same backwards, of windows here and of the same windows read from the other strand.
BOTH_WAYS = f"""{REF}, {seeds(ONE_WAY_MASK)}, f AS (SELECT key, count(*) AS n FROM idx GROUP BY key),
b AS (SELECT {TURN.format('k')} AS key, n FROM (SELECT {key(ONE_WAY_MASK[::-1])} AS k, count(*) AS n FROM idx_w GROUP BY 1)),
d AS (SELECT key, coalesce(f.n, 0) AS forward, coalesce(f.n, 0) + coalesce(b.n, 0) AS "both" FROM f FULL JOIN b USING (key))"""
ORACLES["key_distribution_any"] = f"WITH {BOTH_WAYS} SELECT * FROM d"
ORACLES["key_histogram_any"] = f'WITH {BOTH_WAYS} SELECT "both" AS times, count(*) AS keys FROM d GROUP BY "both"'
ORACLES["chunked_repeats"] = ORACLES["tandem_repeats"]
#: A key as a number, two bits a base.
NUMBER = "list_sum([(strpos('acgt', substr(key, i::BIGINT, 1)) - 1) * (1::HUGEINT << (2 * (length(key) - i))) FOR i IN range(1, length(key) + 1)])"
ORACLES["chunked_seeds"] = f"""WITH {REF}, {seeds(MASK)}, k AS MATERIALIZED (SELECT key, ({NUMBER} % 65521)::BIGINT AS n FROM (SELECT DISTINCT key FROM idx))
SELECT contig, count(*) AS seeds, sum(pos)::BIGINT AS places, sum(n)::BIGINT AS keys FROM idx JOIN k USING (key) GROUP BY contig"""
ORACLES["match_files"] = ORACLES["cal_masks"]
#: Read keys and those that differ from them in a base.
NEAR = f"""{seeds(MASK)}, {read_keys(MASK, 'own')},
rk AS MATERIALIZED (SELECT DISTINCT read_id, end_no, len, off, strand, substr(key, 1, (p - 1)::BIGINT) || b || substr(key, (p + 1)::BIGINT) AS key
   FROM own, range(1, {MASK.count('1')} + 1) AS r(p), (VALUES ('a'), ('c'), ('g'), ('t')) AS v(b))"""
ORACLES["neighbour_join"] = f"WITH {REF}, {READS}, {matching(keys=NEAR)} SELECT read_id, end_no, contig, position::INT AS position, strand, len(offsets)::INT AS seeds FROM cals"
ORACLES["kept_found"] = f"WITH {PAIRED}, {UNIQUE} SELECT read_id, end_no, contig, position, strand, score FROM a SEMI JOIN b USING (read_id)"
ORACLES["seed_accuracy"] = f"""WITH {REF}, {READS}, {matching(keys=NEAR)},
w AS (SELECT r.seq AS rd, CASE WHEN c.strand = '-' THEN {TURN.format('substr(ref.seq, c.position::BIGINT, c.len)')} ELSE substr(ref.seq, c.position::BIGINT, c.len) END AS wd
      FROM cals c JOIN ref ON c.contig = ref.contig JOIN reads r ON c.read_id = r.read_id AND c.end_no = r.end_no WHERE c.position >= 1 AND c.position + c.len - 1 <= length(ref.seq)),
f AS MATERIALIZED (SELECT array_to_string([CASE WHEN substr(rd, i::BIGINT, 1) = substr(wd, i::BIGINT, 1) THEN '1' ELSE '0' END FOR i IN range(1, length(rd) + 1)], '') AS profile FROM w)
""" + " UNION ALL ".join(
    f"SELECT {k + 1} AS masks, count(*) AS profiles, count(*) FILTER ({' OR '.join(f"regexp_matches(profile, '{x.replace('0', '.')}')" for x in ACCURATE[: k + 1])}) AS found FROM f"
    for k in range(len(ACCURATE))
)
ORACLES["fasta_seeds"] = ORACLES["chunked_seeds"]
