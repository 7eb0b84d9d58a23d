"""DuckDB SQL for the queries, written independently of the Spark plans.

RE2 has no lookahead, so a run of white space before a word is parted first: a
private-use separator goes before its last character.
"""

from __future__ import annotations

from .queries import CHUNK, D, FF, HEADS, MERGES, VOCABULARY

# Fixed value: the characters of Unicode's White_Space.
WHITE = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDS = r"''(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+|[" + WHITE + "]+"


def pretokens(text: str) -> str:
    """SQL for the list of pretokens of a text."""
    parted = rf"regexp_replace({text}, '([{WHITE}]+)([{WHITE}][^{WHITE}])', '\1' || chr(57344) || '\2', 'g')"
    return f"flatten(list_transform(string_split({parted}, chr(57344)), lambda s: regexp_extract_all(s, '{WORDS}')))"


COUNTS = f"counts AS (SELECT p AS pretoken, count(*) AS cnt FROM (SELECT unnest({pretokens('text')}) AS p FROM documents) GROUP BY p)"
HEXED = "lower(hex(encode(pretoken)))"
#: Words of byte tokens.
TOKENS = f"toks AS (SELECT pretoken, cnt, regexp_extract_all({HEXED}, '..') AS t FROM counts)"
PAIRS = "list_zip(t[:-2], t[2:])"


def trained(counts: str = COUNTS) -> str:
    """CTEs rec (every round's words with its best pair) and merges (rank, l, r, n)."""
    best = "(SELECT p[1] AS l, p[2] AS r, sum(cnt) AS n FROM (SELECT unnest(list_zip(t[:-2], t[2:])) AS p, cnt FROM (SELECT string_split(w[2:-2], '><') AS t, cnt FROM {0}) WHERE len(t) > 1) GROUP BY ALL ORDER BY n DESC, l DESC, r DESC LIMIT 1)"
    return f"""{counts},
w0 AS (SELECT regexp_replace({HEXED}, '(..)', '<\\1>', 'g') AS w, cnt FROM counts),
rec AS (
  SELECT 0 AS it, w, cnt, l, r, n FROM w0, {best.format("w0")}
  UNION ALL
  (WITH x AS MATERIALIZED (
     SELECT it + 1 AS it, replace(w, '<' || l || '><' || r || '>', '<' || l || r || '>') AS w, cnt FROM rec WHERE it < {MERGES - 1}
   ) SELECT it, w, cnt, b.l, b.r, b.n FROM x, {best.format("x")} b)
),
merges AS (SELECT DISTINCT it AS rank, l, r, n FROM rec)"""


def segmented(n_merges: int, window: int = 1000) -> str:
    """CTE st(k, w, n): the pretokens k with their symbols w after this many merges; the row of '' counts them.

    A round merges the pairs in order (y: count, then names) as long as nothing
    that earlier ones of the round can give rise to (z: the greatest name that a
    pair beside them can take, with its count) comes before the next one.
    """
    key = "lpad({}::VARCHAR, 18, '0') || ' ' || {} || ' ' || {}".format
    best = "(SELECT {} AS x, max({}) AS e FROM {} GROUP BY ALL)".format
    return f"""st(k, w, n) USING KEY (k) AS (
  SELECT pretoken, regexp_replace({HEXED}, '(..)', '<\\1>', 'g'), cnt::BIGINT FROM counts UNION ALL SELECT '', '', 0
  UNION
  (WITH now AS MATERIALIZED (SELECT k, w, n FROM recurring.st WHERE k = '' OR contains(w, '><')),
   p AS MATERIALIZED (SELECT q[1] AS l, q[2] AS r, sum(n)::BIGINT AS n FROM (SELECT unnest(list_zip(t[:-2], t[2:])) AS q, n FROM (SELECT string_split(w[2:-2], '><') AS t, n FROM now WHERE k <> '')) GROUP BY ALL),
   top AS MATERIALIZED (SELECT *, {key("n", "l", "r")} AS y FROM p WHERE n >= (SELECT min(n) FROM (SELECT n FROM p ORDER BY n DESC LIMIT {window}))),
   grown AS MATERIALIZED (SELECT l, r, {key("n", "greatest(l, a.e)", "greatest(r, b.e)")} AS z FROM top LEFT JOIN {best("r", "l || r", "top")} a ON a.x = l LEFT JOIN {best("l", "l || r", "top")} b ON b.x = r),
   bound AS (SELECT l, r, y, greatest(a.e, b.e) AS z FROM top LEFT JOIN {best("r", "z", "grown")} a ON a.x = l LEFT JOIN {best("l", "z", "grown")} b ON b.x = r),
   safe AS (SELECT l, r, y, row_number() OVER (ORDER BY y DESC) AS i, max(z) OVER (ORDER BY y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS z FROM bound),
   fold AS MATERIALIZED (SELECT list(struct_pack(a := '<' || l || '><' || r || '>', b := '<' || l || r || '>') ORDER BY y DESC) AS m FROM safe WHERE (z IS NULL OR y > z) AND i <= {n_merges} - (SELECT n FROM now WHERE k = '')),
   new AS (SELECT k, w, n, list_reduce(list_prepend(struct_pack(a := w, b := ''), m), lambda acc, x: struct_pack(a := replace(acc.a, x.a, x.b), b := '')).a AS v FROM now, fold WHERE k <> '' AND m IS NOT NULL)
   SELECT k, v, n FROM new WHERE v <> w UNION ALL SELECT '', '', n + len(m) FROM now, fold WHERE k = '' AND m IS NOT NULL))"""


def vocab(specials: tuple[str, ...] = ()) -> str:
    extra = "".join(f" UNION ALL SELECT {256 + k}, lower(hex(encode('{s}')))" for k, s in enumerate(specials))
    first = 256 + len(specials)
    return f"vocab AS (SELECT i::INT AS token_id, lpad(lower(to_hex(i)), 2, '0') AS hex FROM range(256) x(i){extra} UNION ALL SELECT ({first} + rank)::INT, l || r FROM merges)"


def encoded(source: str, specials: tuple[str, ...] = (), counts: str = COUNTS) -> str:
    """CTE chain to enc(pretoken, ids): the distinct pretokens of ``source`` (a SELECT of pretoken p)."""
    return f"""WITH RECURSIVE {trained(counts)},
{vocab(specials)},
fold AS (SELECT list(struct_pack(a := '<' || l || '><' || r || '>', b := '<' || l || r || '>') ORDER BY rank) AS m FROM merges),
uniq AS (SELECT DISTINCT p AS pretoken FROM ({source})),
words AS (SELECT pretoken, list_reduce(list_prepend(struct_pack(a := regexp_replace({HEXED}, '(..)', '<\\1>', 'g'), b := ''), m),
  lambda acc, z: struct_pack(a := replace(acc.a, z.a, z.b), b := '')).a AS w FROM uniq, fold),
parts AS (SELECT pretoken, generate_subscripts(t, 1) AS k, unnest(t) AS h FROM (SELECT pretoken, string_split(w[2:-2], '><') AS t FROM words)),
enc AS (SELECT pretoken, list(token_id ORDER BY k) AS ids FROM parts JOIN vocab ON hex = h GROUP BY pretoken)"""


DOC_SOURCE = f"SELECT unnest({pretokens('text')}) AS p FROM documents"
#: Tokens of the documents: (doc_id, pos, token_id).
STREAM = f"""{encoded(DOC_SOURCE)},
placed AS (SELECT doc_id, generate_subscripts(ps, 1) AS k, unnest(ps) AS pretoken FROM (SELECT doc_id, {pretokens('text')} AS ps FROM documents)),
docids AS (SELECT doc_id, flatten(list(ids ORDER BY k)) AS ids FROM placed JOIN enc USING (pretoken) GROUP BY doc_id),
stream AS (SELECT doc_id, (generate_subscripts(ids, 1) - 1)::INT AS pos, unnest(ids) AS token_id FROM docids)"""
ALL_DOCS = "(SELECT d.doc_id, d.text, d.lang, coalesce(i.ids, []) AS ids FROM documents d LEFT JOIN docids i USING (doc_id))"

VEC = "v AS (SELECT vec_id, label, vec_id // 10 AS seq, vec_id % 10 AS pos, (generate_subscripts(embedding, 1) - 1)::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
PHASE = {"linear": 0, "q": 1, "k": 2, "v": 3, "o": 4, "w1": 5, "w2": 6, "w3": 7, "lm": 8}
#: The place of a vector's greatest component.
ARGMAX = "(list_position(embedding, list_max(embedding)) - 1)"


def product(name: str, source: str, d_out: int, d_in: int, out: str) -> str:
    return f"{out} AS (SELECT vec_id, seq, pos, o::INT AS i, sum(x * 0.1 * sin(0.1 * (o * {d_in} + i) + {PHASE[name]})) AS x FROM {source}, range({d_out}) t(o) GROUP BY ALL)"


def turned(source: str, width: int, out: str) -> str:
    """Rotary positions over groups of ``width`` neighbours."""
    angle = f"a.pos * pow(10000.0, -((a.i % {width}) // 2 * 2) / {width}.0)"
    return f"{out} AS (SELECT a.vec_id, a.seq, a.pos, a.i, CASE WHEN a.i % 2 = 0 THEN a.x * cos({angle}) - b.x * sin({angle}) ELSE b.x * sin({angle}) + a.x * cos({angle}) END AS x FROM {source} a JOIN {source} b ON a.vec_id = b.vec_id AND b.i = CASE WHEN a.i % 2 = 0 THEN a.i + 1 ELSE a.i - 1 END)"


def attended(q: str, k: str, v: str, heads: int, allowed: str, out: str) -> str:
    dk = D // heads
    return f"""{out}_s AS (SELECT a.vec_id, a.seq, a.pos, b.vec_id AS other, a.i // {dk} AS h, sum(a.x * b.x) / sqrt({dk}.0) AS s
  FROM {q} a JOIN {k} b ON a.seq = b.seq AND a.i = b.i AND ({allowed}) GROUP BY ALL),
{out}_p AS (SELECT *, exp(s - max(s) OVER g) / sum(exp(s)) OVER g * exp(max(s) OVER g) AS p FROM {out}_s WINDOW g AS (PARTITION BY vec_id, h)),
{out} AS (SELECT p.vec_id, p.seq, p.pos, c.i, sum(p.p * c.x) AS x FROM {out}_p p JOIN {v} c ON c.vec_id = p.other AND c.i // {dk} = p.h GROUP BY ALL)"""


def multi_head(rotary: bool) -> str:
    parts = [VEC, *(product(k, "v", D, D, f"m{k}") for k in "qkv")]
    q, k = "mq", "mk"
    if rotary:
        parts += [turned("mq", D // HEADS, "rq"), turned("mk", D // HEADS, "rk")]
        q, k = "rq", "rk"
    parts += [attended(q, k, "mv", HEADS, "b.pos <= a.pos", "att"), product("o", "att", D, D, "y")]
    return f"WITH {', '.join(parts)} SELECT vec_id, i, round(x, 6) + 0.0 AS y FROM y"


def normed(source: str, gain: str, out: str) -> str:
    return f"{out} AS (SELECT vec_id, seq, pos, i, x / sqrt(avg(x * x) OVER (PARTITION BY vec_id) + 1e-5) * {gain} AS x FROM {source})"


def added(one: str, two: str, out: str) -> str:
    return f"{out} AS (SELECT a.vec_id, a.seq, a.pos, a.i, a.x + b.x AS x FROM {one} a JOIN {two} b USING (vec_id, i))"


def block(source: str, t: str) -> list[str]:
    """CTEs of a pre-norm block; the last is ``{t}y``."""
    gain = "(1 + 0.01 * i)"
    return [
        normed(source, gain, f"{t}n1"),
        *(product(k, f"{t}n1", D, D, f"{t}{k}") for k in "qkv"),
        turned(f"{t}q", D // HEADS, f"{t}rq"),
        turned(f"{t}k", D // HEADS, f"{t}rk"),
        attended(f"{t}rq", f"{t}rk", f"{t}v", HEADS, "b.pos <= a.pos", f"{t}att"),
        product("o", f"{t}att", D, D, f"{t}o"),
        added(source, f"{t}o", f"{t}h"),
        normed(f"{t}h", gain, f"{t}n2"),
        product("w1", f"{t}n2", FF, D, f"{t}a"),
        product("w3", f"{t}n2", FF, D, f"{t}b"),
        f"{t}g AS (SELECT a.vec_id, a.seq, a.pos, a.i, a.x / (1 + exp(-a.x)) * b.x AS x FROM {t}a a JOIN {t}b b USING (vec_id, i))",
        product("w2", f"{t}g", D, FF, f"{t}f"),
        added(f"{t}h", f"{t}f", f"{t}y"),
    ]


def literal(h: str) -> str:
    """SQL for the bytes literal of a hexadecimal text."""
    digit = "instr('0123456789abcdef', x[{0}]) - 1"
    values = f"list_transform(regexp_extract_all({h}, '..'), lambda x: 16 * ({digit.format(1)}) + {digit.format(2)})"
    mark = f"CASE WHEN list_contains({values}, 34) THEN chr(92) || chr(39) ELSE chr(39) END"
    quote = f"CASE WHEN list_contains({values}, 39) AND NOT list_contains({values}, 34) THEN chr(34) ELSE chr(39) END"
    named = " ".join(f"WHEN b = {b} THEN chr(92) || '{c}'" for b, c in ((9, "t"), (10, "n"), (13, "r"), (92, "\\")))
    one = f"CASE {named} WHEN b = 39 THEN {mark} WHEN b BETWEEN 32 AND 126 THEN chr(b::INT) ELSE chr(92) || 'x' || lpad(lower(to_hex(b)), 2, '0') END"
    return f"'b' || {quote} || array_to_string(list_transform({values}, lambda b: {one}), '') || {quote}"


UTF8 = "CASE WHEN token_id < 128 THEN chr(token_id) WHEN token_id < 256 THEN NULL ELSE try(decode(unhex(hex))) END"


def oracle_sql() -> dict[str, str]:
    specials = r"\. |<\|end\|>"
    conv = "SELECT unnest(" + pretokens("text") + ") AS p FROM conversations"
    corpora = {"documents": "text", "pages": "html", "conversations": "text", "benchmark": "text"}
    every = " UNION ALL ".join(f"SELECT '{t}' AS corpus, {c} AS t FROM {t}" for t, c in corpora.items())
    train_out = f"WITH RECURSIVE {trained()}, {vocab()}"
    return {
        "pretoken_counts": f"WITH {COUNTS} SELECT pretoken, cnt FROM counts",
        "pretoken_totals": f"WITH {COUNTS} SELECT count(*) AS n_unique, sum(cnt)::BIGINT AS n_total FROM counts",
        "pretoken_spans": f"""WITH p AS (SELECT doc_id, (generate_subscripts(ps, 1) - 1)::INT AS pos, unnest(ps) AS t FROM (SELECT doc_id, {pretokens('text')} AS ps FROM documents)),
e AS (SELECT doc_id, pos, length(t) AS n, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS end_at FROM p)
SELECT doc_id, pos, end_at - n AS start_at, end_at FROM e""",
        "special_split": f"SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS seg, unnest(s) AS segment FROM (SELECT doc_id, string_split_regex(text, '{specials}') AS s FROM documents)",
        "special_segments": f"""WITH a AS (SELECT doc_id, string_split_regex(text, '{specials}') AS n, regexp_extract_all(text, '{specials}') AS f FROM documents),
b AS (SELECT doc_id, 2 * generate_subscripts(n, 1) AS k, unnest(n) AS segment, false AS is_special FROM a UNION ALL SELECT doc_id, 2 * generate_subscripts(f, 1) + 1, unnest(f), true FROM a)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS seg, segment, is_special FROM b WHERE segment <> ''""",
        "byte_counts": f"WITH {COUNTS}, {TOKENS} SELECT b AS byte, sum(cnt)::BIGINT AS n FROM (SELECT unnest(t) AS b, cnt FROM toks) GROUP BY b",
        "initial_pair_counts": f"WITH {COUNTS}, {TOKENS} SELECT p[1] AS l, p[2] AS r, sum(cnt)::BIGINT AS n FROM (SELECT unnest({PAIRS}) AS p, cnt FROM toks WHERE len(t) > 1) GROUP BY ALL",
        "pair_postings": f"WITH {COUNTS}, {TOKENS} SELECT p[1] AS l, p[2] AS r, count(DISTINCT pretoken) AS n_words FROM (SELECT unnest({PAIRS}) AS p, pretoken FROM toks WHERE len(t) > 1) GROUP BY ALL",
        "pair_posting_lists": f"WITH {COUNTS}, {TOKENS} SELECT DISTINCT p[1] AS l, p[2] AS r, pretoken FROM (SELECT unnest({PAIRS}) AS p, pretoken FROM toks WHERE len(t) > 1)",
        "bpe_merges_distributed": f"WITH RECURSIVE {trained()} SELECT rank::INT AS rank, l, r, n::BIGINT AS n FROM merges",
        "bytes_repr": f"{train_out} SELECT token_id, {literal('hex')} AS literal FROM vocab",
        "vocab_json": f"{train_out} SELECT token_id, hex, {literal('hex')} AS literal, {UTF8} AS utf8, (length(hex) // 2)::INT AS n_bytes FROM vocab",
        "merges_text": f"{train_out} SELECT rank::INT AS rank, rank || chr(9) || {literal('l')} || chr(9) || {literal('r')} || chr(9) || {literal('l || r')} AS line FROM merges",
        "transformer_block": f"WITH {', '.join([VEC, *block('v', 't_')])} SELECT vec_id, i, round(x, 6) + 0.0 AS y FROM t_y",
        "transformer_lm": f"""WITH e AS (SELECT vec_id, vec_id // 10 AS seq, vec_id % 10 AS pos, i::INT AS i, 0.1 * sin(0.1 * ({ARGMAX} * {D} + i) + 9) AS x FROM embeddings, range({D}) t(i)),
{', '.join([*block('e', 's_'), *block('s_y', 't_'), normed('t_y', '1', 'z'), product('lm', 'z', 64, D, 'y')])} SELECT vec_id, i, round(x, 6) + 0.0 AS y FROM y""",
        "bpe_merges": f"WITH RECURSIVE {trained()} SELECT rank::INT AS rank, l, r, n::BIGINT AS n FROM merges",
        "bpe_vocab": f"{train_out} SELECT token_id, hex, {UTF8} AS utf8 FROM vocab",
        "encode_tokens": f"{STREAM} SELECT doc_id, pos, token_id FROM stream",
        "encode_with_specials": f"""{encoded(conv, ("<|end|>",))},
placed AS (SELECT conv_id, turn, unnest({pretokens('text')}) AS pretoken FROM conversations),
t AS (SELECT conv_id, turn, sum(len(ids)) AS n, sum(list_sum(ids)) AS s FROM placed JOIN enc USING (pretoken) GROUP BY ALL)
SELECT c.conv_id, c.turn, (coalesce(n, 0) + 1)::INT AS n_tokens, 256 AS last_id, (coalesce(s, 0) + 256)::BIGINT AS id_sum FROM conversations c LEFT JOIN t USING (conv_id, turn)""",
        "doc_token_counts": f"{STREAM} SELECT doc_id, len(ids)::INT AS n_tokens FROM {ALL_DOCS}",
        "token_frequency": f"{STREAM} SELECT token_id, count(*) AS n FROM stream GROUP BY token_id",
        "decode_roundtrip": "SELECT doc_id, true AS same, length(text)::INT AS n_chars FROM documents",
        "decode_invalid_utf8": "SELECT * FROM (VALUES (0, chr(65533), true), (1, 'a' || chr(65533), true), (2, chr(65533) || 'x', true), (3, 'é', false)) t(k, decoded, invalid)",
        "token_stream_stats": f"{STREAM} SELECT count(*) AS n_tokens, coalesce(min(token_id), 0) AS min_id, coalesce(max(token_id), 0) AS max_id FROM stream",
        "token_stream_sha256": f"{STREAM} SELECT doc_id, sha256(unhex(coalesce(array_to_string(list_transform(ids, lambda i: lpad(lower(to_hex(i % 256)), 2, '0') || lpad(lower(to_hex(i // 256)), 2, '0')), ''), ''))) AS sha256 FROM {ALL_DOCS}",
        "compression_ratio": f"""WITH RECURSIVE {COUNTS}, {segmented(VOCABULARY - 256)},
b AS (SELECT lang, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY lang),
t AS (SELECT lang, sum(len(string_split(w[2:-2], '><')))::BIGINT AS n_tokens FROM (SELECT lang, unnest({pretokens('text')}) AS k FROM documents) JOIN st USING (k) GROUP BY lang)
SELECT b.lang, n_bytes, coalesce(n_tokens, 0) AS n_tokens, round(n_bytes / nullif(n_tokens, 0), 6) AS bytes_per_token FROM b LEFT JOIN t ON b.lang IS NOT DISTINCT FROM t.lang""",
        "cross_corpus_compression": f"""{encoded(f"SELECT unnest({pretokens('t')}) AS p FROM ({every})")},
n AS (SELECT corpus, sum(len(ids)) AS k FROM (SELECT corpus, unnest({pretokens('t')}) AS pretoken FROM ({every})) JOIN enc USING (pretoken) GROUP BY corpus),
b AS (SELECT corpus, sum(strlen(t)) AS s FROM ({every}) GROUP BY corpus)
SELECT corpus, s::BIGINT AS n_bytes, k::BIGINT AS n_tokens, round(s / k, 6) AS bytes_per_token FROM n JOIN b USING (corpus)""",
        "longest_tokens": f"{train_out} SELECT token_id, hex, (length(hex) // 2)::INT AS n_bytes FROM vocab QUALIFY rank() OVER (ORDER BY length(hex) DESC) = 1",
        "doc_sample": "SELECT doc_id, lang, md5('336-' || doc_id) AS h FROM documents ORDER BY h, doc_id LIMIT 10",
        "chunk_boundaries": """WITH g AS (SELECT doc_id, text, length(text) AS n, k, (length(text) * k // 8) AS guess FROM documents, range(9) t(k)),
a AS (SELECT *, instr(substr(text, guess + 1), '. ') AS p FROM g)
SELECT DISTINCT doc_id, (CASE WHEN k = 0 THEN 0 WHEN k = 8 OR p = 0 THEN n ELSE guess + p - 1 END)::INT AS boundary FROM a""",
        "text_chunks": f"SELECT doc_id, k::INT AS seq, substr(text, k * {CHUNK} + 1, {CHUNK}) AS chunk FROM documents, range(10000) t(k) WHERE k < greatest(1, ceil(length(text) / {CHUNK}.0))",
        "byte_alphabet": """WITH b AS (SELECT i, i BETWEEN 33 AND 126 OR (i BETWEEN 161 AND 255 AND i <> 173) AS v FROM range(256) t(i))
SELECT i::INT AS byte, (CASE WHEN v THEN i ELSE 255 + row_number() OVER (PARTITION BY v ORDER BY i) END)::INT AS code_point FROM b""",
        "manifest": f"""{STREAM} SELECT lang AS split_name, sum(len(ids))::BIGINT AS token_count, min(list_min(ids)) AS min_id, max(list_max(ids)) AS max_id, sum(strlen(text))::BIGINT AS input_bytes,
round(sum(strlen(text)) / nullif(sum(len(ids)), 0), 6) AS bytes_per_token FROM {ALL_DOCS} GROUP BY lang""",
        "streaming_encode": f"{STREAM} SELECT doc_id, len(ids)::INT AS n_tokens, coalesce(list_sum(ids), 0)::BIGINT AS id_sum FROM {ALL_DOCS}",
        "linear": f"WITH {VEC}, {product('linear', 'v', D, D, 'y')} SELECT vec_id, i, round(x, 6) + 0.0 AS y FROM y",
        "embedding_lookup": f"SELECT vec_id, i::INT AS i, round(0.1 * sin(0.1 * ({ARGMAX} * 8 + i) + 9), 6) AS y FROM embeddings, range(8) t(i)",
        "rope": f"WITH {VEC}, {turned('v', D, 'y')} SELECT vec_id, i, round(x, 6) + 0.0 AS y FROM y",
        "rmsnorm": f"WITH {VEC} SELECT vec_id, i, round(x / sqrt(avg(x * x) OVER (PARTITION BY vec_id) + 1e-5) * (1 + 0.01 * i), 6) AS y FROM v",
        "sigmoid_silu": f"WITH {VEC} SELECT vec_id, i, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(x / (1 + exp(-x)), 6) AS silu FROM v",
        "swiglu": f"WITH {VEC}, {product('w1', 'v', FF, D, 'a')}, {product('w3', 'v', FF, D, 'b')}, g AS (SELECT a.vec_id, a.seq, a.pos, a.i, a.x / (1 + exp(-a.x)) * b.x AS x FROM a JOIN b USING (vec_id, i)), {product('w2', 'g', D, FF, 'y')} SELECT vec_id, i, round(x, 6) + 0.0 AS y FROM y",
        "softmax": f"WITH {VEC} SELECT vec_id, i, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 6) AS y FROM v",
        "sdpa_masked": f"WITH {VEC}, {attended('v', 'v', 'v', 1, '(a.pos + b.pos) % 3 <> 0 OR a.pos = b.pos', 'y')} SELECT vec_id, i, round(x, 6) + 0.0 AS y FROM y",
        "causal_mha": multi_head(False),
        "mha_rope": multi_head(True),
        "get_batch": """WITH h AS (SELECT doc_id, lower(hex(encode(text))) AS h, strlen(text) AS n FROM documents WHERE strlen(text) > 16),
s AS (SELECT *, doc_id * 7919 % (n - 16) AS s FROM h)
SELECT doc_id, substr(h, 2 * s + 1, 32) AS x_hex, substr(h, 2 * s + 3, 32) AS y_hex FROM s""",
        "cross_entropy": f"WITH {VEC}, l AS (SELECT vec_id, ln(sum(exp(x))) - sum(x) FILTER (i = vec_id % {D}) AS loss FROM v GROUP BY vec_id) SELECT round(avg(loss), 6) AS loss, count(*) AS n FROM l",
        "grad_clip": f"WITH {VEC}, n AS (SELECT sqrt(sum(x * x)) AS norm FROM v) SELECT vec_id, i, round(x * CASE WHEN norm > 1 THEN 1 / (norm + 1e-6) ELSE 1 END, 6) + 0.0 AS g FROM v, n",
        "adamw_steps": f"""WITH RECURSIVE {VEC}, st AS (
SELECT 0 AS t, vec_id, i, x, x AS v, 0.0::DOUBLE AS m, 0.0::DOUBLE AS s FROM v
UNION ALL
SELECT t + 1, vec_id, i, x,
  v * (1 - 1e-3 * 0.01) - 1e-3 / (1 - pow(0.9, t + 1)) * (0.9 * m + 0.1 * g) / (sqrt((0.999 * s + 0.001 * g * g) / (1 - pow(0.999, t + 1))) + 1e-8),
  0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
FROM (SELECT *, x * (1 + 0.1 * (t + 1)) AS g FROM st WHERE t < 5))
SELECT vec_id, i, round(v, 6) AS v FROM st WHERE t = 5""",
        "lr_schedule": "SELECT i AS it, round(CASE WHEN i < 7 THEN i / 7 WHEN i <= 21 THEN 0.1 + 0.5 * (1 + cos((i - 7) / 14 * pi())) * 0.9 ELSE 0.1 END, 6) AS lr FROM range(25) t(i)",
        "checkpoint_roundtrip": f"WITH {VEC} SELECT vec_id, 7 AS iteration, count(*) AS n, round(sum(x), 6) AS total FROM v GROUP BY vec_id",
        "d_ff_default": "SELECT i * 32 AS d, greatest(64, floor((8 * i * 32 / 3 + 32) / 64) * 64)::BIGINT AS d_ff FROM range(1, 65) t(i)",
        "duration_format": "SELECT doc_id, printf('%d min %.2f sec', (n_chars // 420)::INT, n_chars / 7 - (n_chars // 420) * 60) AS duration FROM documents",
    }
