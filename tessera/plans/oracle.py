"""DuckDB twins of the catalog queries (the correctness gate).

Written independently of the Spark code path, from the operator semantics:
templates are expanded here with plain ``str`` splitting, orders use
``row_number()`` over the whole table, and lists are compared as
length + md5 of their space-joined text.
"""

from __future__ import annotations

from tessera.functions.fixed import EOS_TOKEN, MARKER_PATTERN, PORTABLE_PRETOKEN_PATTERN, SPECIAL_TOKENS, TEMPLATE_ROWS
from tessera.plans import catalog as C
from tessera.sources.tables import public_tokenizer_path

P = PORTABLE_PRETOKEN_PATTERN
TPL = {row[0]: row for row in TEMPLATE_ROWS}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# FIXED VALUES: Unicode's white space, spelled out (\\s of RE2 is ASCII only)
WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# the seven branches without lookahead: before the last blank of a run that a word follows, the text is split
FULL = (r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^" + WS + r"\p{L}\p{N}]+[\r\n]*|["
        + WS + r"]*[\r\n]+|[" + WS + r"]+")
RUN_END = f"([{WS}])([{WS.replace(chr(92) + 'n', '').replace(chr(92) + 'r', '')}][^{WS}])"


def portable_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(P)})"


def full_tokens(x: str) -> str:
    cut = f"string_split(regexp_replace({x}, {lit(RUN_END)}, '\\1' || chr(0) || '\\2', 'g'), chr(0))"
    return f"flatten(list_transform({cut}, lambda part: regexp_extract_all(part, {lit(FULL)})))"


def marker_tokens(x: str, tokens=portable_tokens) -> str:
    """Markers split out first (RE2 has no lookahead: wrap them in NUL and split),
    then each text segment pre-tokenised on its own."""
    markers = ", ".join(lit(m) for m in SPECIAL_TOKENS)
    return (f"flatten(list_transform(string_split(regexp_replace({x}, {lit('(' + MARKER_PATTERN + ')')}, "
            f"chr(0) || '\\1' || chr(0), 'g'), chr(0)), lambda seg: CASE WHEN seg IN ({markers}) THEN [seg] "
            f"ELSE {tokens('seg')} END))")


def fmt_sql(fmt: str, content_sql: str, eos: str | None = EOS_TOKEN) -> str:
    """SQL for fmt.format(content=..., stop_token=eos) with {content} spliced as SQL."""
    if eos is not None:
        fmt = fmt.replace("{stop_token}", eos)
    parts = fmt.split("{content}")
    out = lit(parts[0])
    for p in parts[1:]:
        out += f" || {content_sql} || {lit(p)}"
    return out


def system_block(name: str) -> str:
    _, sysfmt, _, _, system, _ = TPL[name]
    if not system:
        return ""
    return sysfmt.replace("{content}", system)


def md5_list(x: str) -> str:
    return f"md5(array_to_string({x}, ' '))"


def n(x: str) -> str:
    return f"CAST(len({x}) AS BIGINT)"


def pmod(a: str, b: str) -> str:
    return f"((({a}) % ({b})) + ({b})) % ({b})"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


# --- shared CTE blocks -----------------------------------------------------------

def encode_ctes(src: str, key: str, prefix: str, flags: bool = False) -> str:
    """``src`` has (key, tokens[, sup]); defines <prefix>ex, <prefix>vocab, <prefix>enc(key, ids[, labels])."""
    sup_sel = ", sup[i + 1] AS sup" if flags else ""
    lab = ", list(CASE WHEN x.sup THEN v.id ELSE -100 END ORDER BY x.i) AS labels" if flags else ""
    lab_out = ", coalesce(e.labels, CAST([] AS INTEGER[])) AS labels" if flags else ""
    return f"""
{prefix}ex AS (SELECT {key}, i, tokens[i + 1] AS token{sup_sel}
      FROM (SELECT *, unnest(range(len(tokens))) AS i FROM {src})),
{prefix}vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) - 1 AS INTEGER) AS id,
      CAST(cnt AS BIGINT) AS count FROM (SELECT token, count(*) AS cnt FROM {prefix}ex GROUP BY token)),
{prefix}enc0 AS (SELECT x.{key}, list(v.id ORDER BY x.i) AS ids{lab}
      FROM {prefix}ex x JOIN {prefix}vocab v USING (token) GROUP BY x.{key}),
{prefix}enc AS (SELECT t.{key}, coalesce(e.ids, CAST([] AS INTEGER[])) AS ids{lab_out}
      FROM {src} t LEFT JOIN {prefix}enc0 e USING ({key}))"""


PRETRAIN = f"""
docs AS (SELECT doc_id AS pos, text FROM documents),
toks AS (SELECT pos, {marker_tokens("nfc_normalize(text)")} AS tokens FROM docs),
{encode_ctes("toks", "pos", "p")}"""


# --- byte-level BPE --------------------------------------------------------------

BYTES = """
balpha AS (SELECT list(CASE WHEN own THEN chr(b) ELSE chr(CAST(255 + k AS INTEGER)) END ORDER BY b) AS a
           FROM (SELECT b, own, row_number() OVER (PARTITION BY own ORDER BY b) AS k FROM (
                 SELECT CAST(range AS INTEGER) AS b, range BETWEEN 33 AND 126 OR range BETWEEN 161 AND 172
                        OR range BETWEEN 174 AND 255 AS own FROM range(256))))"""
SYMBOLS = ("list_transform(range(octet_length(encode(token))), lambda i: a[CAST('0x' || "
           "substr(hex(encode(token)), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) + 1])")


def file_tables() -> str:
    """bvoc(token, id) and bmrg(l, r, rank) of the installed tokeniser file; missing markers get the next ids."""
    markers = ", ".join(f"({lit(m)}, {i})" for i, m in enumerate(SPECIAL_TOKENS))
    return f"""
btk AS (SELECT CAST(content AS JSON) AS j FROM read_text({lit(public_tokenizer_path())})),
bown AS (SELECT e.key AS token, e.value AS id
         FROM (SELECT unnest(map_entries(json_transform(j->'$.model.vocab', '"MAP(VARCHAR,INTEGER)"'))) AS e FROM btk)),
badd AS (SELECT a.content AS token, a.id AS id
         FROM (SELECT unnest(json_transform(j->'$.added_tokens', '[{{"content":"VARCHAR","id":"INTEGER"}}]')) AS a FROM btk)),
bheld AS (SELECT * FROM bown UNION ALL SELECT * FROM badd WHERE token NOT IN (SELECT token FROM bown)),
bvoc AS (SELECT * FROM bheld UNION ALL
         SELECT m, CAST((SELECT max(id) FROM bheld) + row_number() OVER (ORDER BY o) AS INTEGER)
         FROM (VALUES {markers}) v(m, o) WHERE m NOT IN (SELECT token FROM bheld)),
bmrg AS (SELECT p[1] AS l, p[2] AS r, rank FROM (
         SELECT unnest(ps) AS p, unnest(range(len(ps))) AS rank
         FROM (SELECT json_transform(j->'$.model.merges', '[["VARCHAR"]]') AS ps FROM btk)))"""


def counted_tables(src: str, merges: int) -> str:
    """The fixture's tables: the most frequent pairs of byte symbols over the words of ``src`` (tokens), in one pass."""
    markers = ", ".join(f"({lit(m)}, {256 + merges + i})" for i, m in enumerate(SPECIAL_TOKENS))
    return f"""
bcw AS (SELECT token, count(*) AS c FROM (SELECT unnest(tokens) AS token FROM {src}) GROUP BY token),
bcp AS (SELECT l, r, sum(c) AS n FROM (SELECT c, unnest(x[:-2]) AS l, unnest(x[2:]) AS r
        FROM (SELECT c, {SYMBOLS} AS x FROM bcw, balpha)) GROUP BY l, r),
bmrg AS (SELECT l, r, CAST(row_number() OVER (ORDER BY n DESC, l, r) - 1 AS INTEGER) AS rank FROM bcp
         QUALIFY row_number() OVER (ORDER BY n DESC, l, r) <= {merges}),
bvoc AS (SELECT a[b + 1] AS token, CAST(b AS INTEGER) AS id FROM balpha, range(256) t(b)
         UNION ALL SELECT l || r, 256 + rank FROM bmrg
         UNION ALL SELECT m, CAST(o AS INTEGER) FROM (VALUES {markers}) v(m, o))"""


def bpe_ctes(src: str, key: str, prefix: str, flags: bool = False, tables: str | None = None) -> str:
    """``src`` has (key, tokens[, sup]); defines <prefix>enc(key, ids[, labels]) by the merges of ``tables``.

    Symbols of a word are wrapped in chr(1) .. chr(2), so replacing a wrapped pair merges its
    occurrences from left to right; every round replaces each word's pair of the lowest rank.
    """
    sup_sel = ", sup[i + 1] AS sup" if flags else ""
    lab = (", flatten(list(CASE WHEN x.sup THEN d.ids ELSE list_transform(d.ids, lambda z: -100) END ORDER BY x.i)) AS labels"
           if flags else "")
    lab_out = ", coalesce(e.labels, CAST([] AS INTEGER[])) AS labels" if flags else ""
    return f"""{BYTES},
{tables or file_tables()},
{prefix}ex AS (SELECT {key}, i, tokens[i + 1] AS token{sup_sel}
      FROM (SELECT *, unnest(range(len(tokens))) AS i FROM {src})),
bword AS (SELECT DISTINCT token FROM {prefix}ex WHERE token NOT IN ({", ".join(lit(m) for m in SPECIAL_TOKENS)})),
bpe(token, s, step) AS (
  SELECT token, array_to_string(list_transform({SYMBOLS}, lambda y: chr(1) || y || chr(2)), ''), 0
  FROM bword, balpha
  UNION ALL
  SELECT token, replace(s, chr(1) || l || chr(2) || chr(1) || r || chr(2), chr(1) || l || r || chr(2)), step + 1
  FROM (SELECT token, s, step, arg_min(m.l, rank) AS l, arg_min(m.r, rank) AS r
        FROM (SELECT token, s, step, unnest(x[:-2]) AS l, unnest(x[2:]) AS r
              FROM (SELECT *, string_split(s[2:-2], chr(2) || chr(1)) AS x FROM bpe)) p
        JOIN bmrg m ON m.l = p.l AND m.r = p.r GROUP BY token, s, step)),
bdone AS (SELECT token, string_split(arg_max(s, step)[2:-2], chr(2) || chr(1)) AS x FROM bpe GROUP BY token),
bdict AS (SELECT d.token, list(v.id ORDER BY i) AS ids
          FROM (SELECT token, unnest(x) AS piece, unnest(range(len(x))) AS i FROM bdone) d
          JOIN bvoc v ON v.token = d.piece GROUP BY d.token
          UNION ALL SELECT token, [id] FROM bvoc WHERE token IN ({", ".join(lit(m) for m in SPECIAL_TOKENS)})),
{prefix}enc0 AS (SELECT x.{key}, flatten(list(d.ids ORDER BY x.i)) AS ids{lab}
      FROM {prefix}ex x JOIN bdict d USING (token) GROUP BY x.{key}),
{prefix}enc AS (SELECT t.{key}, coalesce(e.ids, CAST([] AS INTEGER[])) AS ids{lab_out}
      FROM {src} t LEFT JOIN {prefix}enc0 e USING ({key}))"""


MARKED = f"""
docs AS (SELECT doc_id AS pos, text || {lit(SPECIAL_TOKENS[0])} || source || {lit(SPECIAL_TOKENS[2])} AS text FROM documents),
toks AS (SELECT pos, {marker_tokens("nfc_normalize(text)", full_tokens)} AS tokens FROM docs)"""


def shard_ctes(src: str, workers: int, batch: int, name: str = "sb") -> str:
    """(…, shard, inner, batch) for contiguous sharding of ``src`` by pos."""
    return f"""
{name}p AS (SELECT count(*) // {workers} AS q, count(*) % {workers} AS m FROM {src}),
{name}0 AS (SELECT s.*, CASE WHEN s.pos < p.m * (p.q + 1) THEN s.pos // (p.q + 1)
                 ELSE p.m + (s.pos - p.m * (p.q + 1)) // p.q END AS shard, p.q, p.m
            FROM {src} s, {name}p p),
{name} AS (SELECT * EXCLUDE (q, m, inner0), CAST(inner0 AS BIGINT) AS in_shard, CAST(inner0 // {batch} AS BIGINT) AS batch
           FROM (SELECT *, pos - CASE WHEN shard < m THEN shard * (q + 1) ELSE m * (q + 1) + (shard - m) * q END AS inner0
                 FROM {name}0))"""


def pack_sql(src: str, length: int, keep_tail: bool = False, scope: str = "shard") -> str:
    """``src`` has (<scope>, shard, batch, pos, ids); returns a SELECT of packed chunks
    (``scope`` names the column that separates independent streams, e.g. a file)."""
    kept = "total" if keep_tail else f"CASE WHEN total >= {length} THEN (total // {length}) * {length} ELSE total END"
    keys = "shard, batch" if scope == "shard" else f"{scope}, shard, batch"
    return f"""
w AS (SELECT {keys}, pos, ids, CAST(len(ids) AS BIGINT) AS nn,
             CAST(sum(len(ids)) OVER (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e,
             CAST(sum(len(ids)) OVER (PARTITION BY {keys}) AS BIGINT) AS total FROM {src}),
s AS (SELECT *, e - nn AS st, least(e, {kept}) AS stop FROM w),
pieces AS (SELECT {keys}, c AS chunk, greatest(c * {length}, st) AS lo,
                  list_slice(ids, greatest(c * {length}, st) - st + 1, least((c + 1) * {length}, stop) - st) AS piece
           FROM (SELECT *, unnest(range(st // {length}, (stop - 1) // {length} + 1)) AS c FROM s WHERE stop > st)),
packed AS (SELECT {keys}, chunk, flatten(list(piece ORDER BY lo)) AS ids FROM pieces GROUP BY {keys}, chunk)"""


# --- pretraining -----------------------------------------------------------------

def _pretrain_packed_body(workers, keep_tail=False):
    return f"""WITH {PRETRAIN},
{shard_ctes("penc", workers, C.PACK_BATCH)},
{pack_sql("sb", C.PACK_LEN, keep_tail)}"""


SQL: dict[str, str] = {}

SQL["pretrain_pretokens"] = f"""WITH {PRETRAIN}
SELECT pos, {n("tokens")} AS n_tokens, {md5_list("tokens")} AS tokens_md5 FROM toks"""

SQL["pretrain_vocab"] = f"""WITH {PRETRAIN}
SELECT token, id, count FROM pvocab"""

SQL["pretrain_encoded"] = f"""WITH {PRETRAIN}
SELECT pos, {n("ids")} AS n_tokens, {md5_list("ids")} AS ids_md5, {md5_list("ids")} AS labels_md5 FROM penc"""

SQL["pretrain_map_batches"] = f"""WITH {shard_ctes("(SELECT doc_id AS pos FROM documents)", C.MAPB_WORKERS, C.MAPB_BATCH)}
SELECT pos, CAST(shard AS BIGINT) AS shard, batch, in_shard FROM sb"""

SQL["pretrain_packed"] = _pretrain_packed_body(C.PACK_WORKERS) + f"""
SELECT CAST(shard AS BIGINT) AS shard, batch, CAST(chunk AS BIGINT) AS chunk, {n("ids")} AS n_tokens,
       {md5_list("ids")} AS ids_md5 FROM packed"""

SQL["pretrain_packed_tail"] = _pretrain_packed_body(1, keep_tail=True) + f"""
SELECT CAST(shard AS BIGINT) AS shard, batch, CAST(chunk AS BIGINT) AS chunk, {n("ids")} AS n_tokens,
       {md5_list("ids")} AS ids_md5 FROM packed"""

SQL["prepared_counts"] = _pretrain_packed_body(C.PACK_WORKERS) + """
SELECT CAST(shard AS BIGINT) AS shard, count(*) AS samples, CAST(sum(len(ids)) AS BIGINT) AS tokens
FROM packed GROUP BY shard"""

SQL["pretrain_full_pretokens"] = f"""WITH docs AS (SELECT doc_id AS pos, text FROM documents),
toks AS (SELECT pos, {marker_tokens("nfc_normalize(text)", full_tokens)} AS tokens FROM docs)
SELECT pos, {n("tokens")} AS n_tokens, {md5_list("tokens")} AS tokens_md5 FROM toks"""

SQL["bpe_encoded"] = f"""WITH RECURSIVE docs AS (SELECT doc_id AS pos, text FROM documents),
toks AS (SELECT pos, {marker_tokens("nfc_normalize(text)", full_tokens)} AS tokens FROM docs),
{bpe_ctes("toks", "pos", "p", tables=counted_tables("toks", C.BPE_MERGES))}
SELECT pos, {n("ids")} AS n_tokens, {md5_list("ids")} AS ids_md5 FROM penc"""

SQL["pretrain_decoded"] = f"""WITH {PRETRAIN}
SELECT pos, CAST(length(array_to_string(tokens, '')) AS BIGINT) AS n_chars,
       md5(array_to_string(tokens, '')) AS text_md5 FROM toks"""

SQL["pretrain_preview"] = _pretrain_packed_body(C.PACK_WORKERS) + """,
first AS (SELECT ids FROM packed ORDER BY shard, batch, chunk LIMIT 1),
fx AS (SELECT i, ids[i + 1] AS id FROM (SELECT ids, unnest(range(len(ids))) AS i FROM first))
SELECT string_agg(v.token, ' ' ORDER BY fx.i) AS preview FROM fx JOIN pvocab v USING (id)"""

def _bpe_sql() -> dict[str, str]:
    """Twins that read the installed tokeniser file; none where there is none."""
    encoded = f"WITH RECURSIVE {MARKED}, {bpe_ctes('toks', 'pos', 'p')}"
    return {
        "pretrain_encoded_bpe": encoded + f"""
SELECT pos, {n("ids")} AS n_tokens, {md5_list("ids")} AS ids_md5 FROM penc""",
        "pretrain_packed_bpe": encoded + f""",
{shard_ctes("penc", C.PACK_WORKERS, C.PACK_BATCH)},
{pack_sql("sb", C.PACK_LEN)}
SELECT CAST(shard AS BIGINT) AS shard, batch, CAST(chunk AS BIGINT) AS chunk, {n("ids")} AS n_tokens,
       {md5_list("ids")} AS ids_md5 FROM packed""",
        "sft_prepared_bpe": f"""WITH RECURSIVE {CONV}, {rend_cte(C.SFT_TEMPLATE)},
mt AS (SELECT pos, list_transform(r, lambda m: {{'role': m.role, 't': {marker_tokens('nfc_normalize(m.text)', full_tokens)}}}) AS mt FROM rend),
stoks AS (SELECT pos, flatten(list_transform(mt, lambda m: m.t)) AS tokens,
                 flatten(list_transform(mt, lambda m: list_transform(m.t, lambda x: m.role = 'assistant'))) AS sup FROM mt),
{bpe_ctes("stoks", "pos", "s", flags=True)},
{shard_ctes("senc", C.SFT_WORKERS, C.SFT_BATCH)},
k AS (SELECT * FROM sb WHERE len(ids) <= {C.BPE_MAX_LEN})
SELECT pos, CAST(shard AS BIGINT) AS shard, batch,
       CAST(row_number() OVER (PARTITION BY shard, batch ORDER BY len(ids), pos) - 1 AS BIGINT) AS rank_in_batch,
       CAST(row_number() OVER (ORDER BY shard, batch, len(ids), pos) - 1 AS BIGINT) AS out_pos,
       {n("ids")} AS n_full, {md5_list("ids")} AS ids_md5, {md5_list("labels")} AS labels_md5
FROM k""",
        "reward_tokens_bpe": f"""WITH RECURSIVE {PAIRS},
rt AS (SELECT pair_id * 2 AS side, {marker_tokens('nfc_normalize(' + _prompt(C.SFT_TEMPLATE, 'question') + ' || ' + fmt_sql(TPL[C.SFT_TEMPLATE][3], 'response_chosen') + ')', full_tokens)} AS tokens FROM pairs
       UNION ALL
       SELECT pair_id * 2 + 1, {marker_tokens('nfc_normalize(' + _prompt(C.SFT_TEMPLATE, 'question') + ' || ' + fmt_sql(TPL[C.SFT_TEMPLATE][3], 'response_rejected') + ')', full_tokens)} FROM pairs),
{bpe_ctes("rt", "side", "r")}
SELECT c.side // 2 AS pair_id, {n("c.ids")} AS n_chosen, {n("r.ids")} AS n_rejected, {md5_list("c.ids")} AS chosen_md5,
       {md5_list("r.ids")} AS rejected_md5
FROM renc c JOIN renc r ON r.side = c.side + 1 AND c.side % 2 = 0
WHERE len(c.ids) <= {C.BPE_MAX_LEN} AND len(r.ids) <= {C.BPE_MAX_LEN}""",
    }


SQL["pretrain_decoded_bpe"] = f"""WITH d AS (
  SELECT doc_id AS pos, nfc_normalize(text || {lit(SPECIAL_TOKENS[0])} || source || {lit(SPECIAL_TOKENS[2])}) AS text FROM documents)
SELECT pos, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM d"""


def file_ctes(src: str, per_file: int, workers: int, batch: int) -> str:
    """``src`` has a dense ``pos``; defines fb with file_index, shard and batch of each file's rows."""
    return f"""
fl AS (SELECT s.*, CAST(pos // {per_file} AS INTEGER) AS file_index, pos % {per_file} AS line,
              count(*) OVER (PARTITION BY pos // {per_file}) AS nf FROM {src} s),
fq AS (SELECT *, nf // {workers} AS q, nf % {workers} AS m FROM fl),
fs AS (SELECT *, CASE WHEN line < m * (q + 1) THEN line // (q + 1) ELSE m + (line - m * (q + 1)) // q END AS shard FROM fq),
fb AS (SELECT * EXCLUDE (q, m, line, nf), CAST((line - CASE WHEN shard < m THEN shard * (q + 1)
              ELSE m * (q + 1) + (shard - m) * q END) // {batch} AS BIGINT) AS batch FROM fs)"""


SQL["files_pretrain"] = f"""WITH {PRETRAIN},
{file_ctes("penc", C.FILE_DOCS, C.FILE_WORKERS, C.PACK_BATCH)},
{pack_sql("fb", C.PACK_LEN, scope="file_index")}
SELECT file_index, CAST(row_number() OVER (ORDER BY file_index, shard, batch, chunk) - 1 AS BIGINT) AS pos,
       CAST(shard AS BIGINT) AS shard, batch, CAST(chunk AS BIGINT) AS chunk, {n("ids")} AS n_tokens,
       {md5_list("ids")} AS ids_md5 FROM packed"""

SQL["stream_ledger"] = f"""WITH {PRETRAIN},
{file_ctes("penc", C.FILE_DOCS, 1, C.STREAM_BATCH)},
{pack_sql("fb", C.STREAM_LEN, scope="file_index")}
SELECT file_index, CAST(row_number() OVER (PARTITION BY file_index ORDER BY batch, chunk) - 1 AS BIGINT) AS in_file, batch,
       CAST(chunk AS BIGINT) AS chunk, {n("ids")} AS n_tokens, {md5_list("ids")} AS ids_md5, true AS dense FROM packed"""

SQL["documents_nfc"] = """SELECT doc_id AS pos, md5(nfc_normalize(text)) AS text_md5, nfc_normalize(text) <> text AS changed
FROM documents"""

SQL["bpe_roundtrip"] = """SELECT doc_id AS pos, CAST(length(nfc_normalize(text)) AS BIGINT) AS n_chars,
       md5(nfc_normalize(text)) AS text_md5 FROM documents"""

SQL["stream_prepared"] = f"""WITH {PRETRAIN},
lp AS (SELECT d.lang, 0 AS shard, e.ids, row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id) - 1 AS pos
       FROM penc e JOIN documents d ON d.doc_id = e.pos),
sb AS (SELECT lang, shard, pos // {C.STREAM_BATCH} AS batch, pos, ids FROM lp),
{pack_sql("sb", C.STREAM_LEN, scope="lang")}
SELECT CAST(shard AS BIGINT) AS shard, CAST(batch AS BIGINT) AS batch, CAST(chunk AS BIGINT) AS chunk,
       {n("ids")} AS n_tokens, {md5_list("ids")} AS ids_md5 FROM packed"""

SQL["documents_concat"] = """WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS lp,
                  dense_rank() OVER (ORDER BY lang) - 1 AS file_index FROM documents),
sz AS (SELECT file_index, count(*) AS c FROM d GROUP BY file_index),
off AS (SELECT file_index, coalesce(sum(c) OVER (ORDER BY file_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM sz)
SELECT CAST(o + lp AS BIGINT) AS pos, CAST(file_index AS INTEGER) AS file_index, doc_id FROM d JOIN off USING (file_index)"""


# the share is a share of the 2^32 values of the first eight hex digits
SQL["documents_split"] = f"""SELECT doc_id AS pos,
  CASE WHEN CAST('0x' || substr(md5('{C.SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT)
            < round({C.SPLIT_PERCENT} / 100 * 4294967296) THEN 'eval' ELSE 'train' END AS split
FROM documents"""


# --- supervised fine-tuning ----------------------------------------------------------

CONV = """conv AS (SELECT conv_id AS pos, list({'role': role, 'content': text} ORDER BY turn) AS msgs
         FROM conversations GROUP BY conv_id)"""


def rendered_msgs_sql(name: str, eos: str = EOS_TOKEN) -> str:
    """list of {role, text}: unknown roles dropped, default system prepended when no system message."""
    _, sysfmt, userfmt, asstfmt, _system, _ = TPL[name]
    sys_case = f"WHEN m.role = 'system' THEN {fmt_sql(sysfmt, 'm.content', None)}" if sysfmt is not None else ""
    body = (
        "list_filter(list_transform(msgs, lambda m: {'role': m.role, 'text': CASE "
        f"{sys_case} WHEN m.role = 'user' THEN {fmt_sql(userfmt, 'm.content', eos)} "
        f"WHEN m.role = 'assistant' THEN {fmt_sql(asstfmt, 'm.content', eos)} END}}), "
        "lambda m: m.role IN ('system', 'user', 'assistant'))"
    )
    block = system_block(name)
    if block:
        return (f"CASE WHEN len(list_filter(msgs, lambda m: m.role = 'system')) > 0 THEN {body} "
                f"ELSE list_concat([{{'role': 'system', 'text': {lit(block)}}}], {body}) END")
    return body


def rend_cte(name: str) -> str:
    return f"rend AS (SELECT pos, {rendered_msgs_sql(name)} AS r FROM conv)"


TEXT = "array_to_string(list_transform(r, lambda m: m.text), '')"

SQL["sft_conversations"] = f"""WITH {CONV}
SELECT pos, {n("msgs")} AS n_messages,
       md5(array_to_string(list_transform(msgs, lambda m: m.role || ':' || m.content), chr(10))) AS conv_md5 FROM conv"""

SQL["sft_rendered"] = f"""WITH {CONV}, {rend_cte(C.SFT_TEMPLATE)}
SELECT pos, {n("r")} AS n_messages, CAST(length({TEXT}) AS BIGINT) AS n_chars, md5({TEXT}) AS text_md5 FROM rend"""

_parts = []
for _name, _row in TPL.items():
    if _row[1] is None:
        continue
    _parts.append(f"""SELECT {lit(_name)} AS template_name, pos, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5
FROM (SELECT pos, array_to_string(list_transform({rendered_msgs_sql(_name)}, lambda m: m.text), '') AS t FROM conv)""")
SQL["sft_rendered_templates"] = f"WITH {CONV}\n" + "\nUNION ALL\n".join(_parts)

# no system message, no default text: the messages' own formats
_plain = []
for _name in ("deepseek", "ziya2", "xverse", "minicpm", "baichuan", "baichuan2", "phi3"):
    _case = (f"CASE m.role WHEN 'user' THEN {fmt_sql(TPL[_name][2], 'm.content')} "
             f"WHEN 'assistant' THEN {fmt_sql(TPL[_name][3], 'm.content')} END")
    _plain.append(f"""SELECT {lit(_name)} AS template_name, pos, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5
FROM (SELECT pos, array_to_string(list_transform(list_filter(msgs, lambda m: m.role IN ('user', 'assistant')),
             lambda m: {_case}), '') AS t FROM conv)""")
SQL["sft_rendered_plain_templates"] = f"WITH {CONV}\n" + "\nUNION ALL\n".join(_plain)

_chat = ("CASE WHEN len(msgs) > 0 AND coalesce(msgs[1].role <> 'system', true) THEN "
         + lit("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n") + " ELSE '' END || "
         "array_to_string(list_transform(msgs, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || "
         "'<|im_end|>' || chr(10)), '') || " + lit("<|im_start|>assistant\n"))
SQL["chat_rendered"] = f"""WITH {CONV}
SELECT pos, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM (SELECT pos, {_chat} AS t FROM conv)"""

SFT = f"""{CONV}, {rend_cte(C.SFT_TEMPLATE)},
mt AS (SELECT pos, list_transform(r, lambda m: {{'role': m.role, 't': {marker_tokens('nfc_normalize(m.text)')}}}) AS mt FROM rend),
stoks AS (SELECT pos, flatten(list_transform(mt, lambda m: m.t)) AS tokens,
                 flatten(list_transform(mt, lambda m: list_transform(m.t, lambda x: m.role = 'assistant'))) AS sup FROM mt),
{encode_ctes("stoks", "pos", "s", flags=True)}"""

SUP = "CAST(len(list_filter(labels, lambda x: x <> -100)) AS BIGINT)"

SQL["sft_tokens"] = f"""WITH {SFT}
SELECT pos, {n("ids")} AS n_tokens, {SUP} AS n_supervised, {md5_list("ids")} AS ids_md5,
       {md5_list("labels")} AS labels_md5 FROM senc"""


def _sft_prepared(discard: bool) -> str:
    where = f"WHERE len(ids) <= {C.SFT_MAX_LEN}" if discard else ""
    return f"""WITH {SFT},
{shard_ctes("senc", C.SFT_WORKERS, C.SFT_BATCH)},
k AS (SELECT * FROM sb {where})
SELECT pos, CAST(shard AS BIGINT) AS shard, batch,
       CAST(row_number() OVER (PARTITION BY shard, batch ORDER BY len(ids), pos) - 1 AS BIGINT) AS rank_in_batch,
       CAST(row_number() OVER (ORDER BY shard, batch, len(ids), pos) - 1 AS BIGINT) AS out_pos,
       {n("ids")} AS n_full, CAST(least(len(ids), {C.SFT_MAX_LEN}) AS BIGINT) AS n_tokens,
       {md5_list(f"list_slice(ids, 1, {C.SFT_MAX_LEN})")} AS ids_md5,
       {md5_list(f"list_slice(labels, 1, {C.SFT_MAX_LEN})")} AS labels_md5
FROM k"""


SQL["sft_prepared"] = _sft_prepared(True)

SQL["sft_preview"] = f"""WITH {SFT},
{shard_ctes("senc", C.SFT_WORKERS, C.SFT_BATCH)},
k AS (SELECT * FROM sb WHERE len(ids) <= {C.SFT_MAX_LEN}),
o AS (SELECT pos, ids, row_number() OVER (ORDER BY shard, batch, len(ids), pos) - 1 AS out_pos FROM k),
f AS (SELECT pos, list_slice(ids, 1, {C.SFT_MAX_LEN}) AS ids FROM o WHERE out_pos = 0),
fx AS (SELECT pos, i, ids[i + 1] AS id FROM (SELECT pos, ids, unnest(range(len(ids))) AS i FROM f))
SELECT pos, string_agg(v.token, ' ' ORDER BY fx.i) AS preview FROM fx JOIN svocab v USING (id) GROUP BY pos"""
SQL["sft_prepared_truncated"] = _sft_prepared(False)

SQL["files_sft"] = f"""WITH {SFT},
{file_ctes("senc", C.FILE_CONVS, C.FILE_WORKERS, C.SFT_BATCH)},
k AS (SELECT * FROM fb WHERE len(ids) <= {C.SFT_MAX_LEN})
SELECT file_index, CAST(row_number() OVER (ORDER BY file_index, shard, batch, len(ids), pos) - 1 AS BIGINT) AS pos,
       CAST(shard AS BIGINT) AS shard, batch, {n("ids")} AS n_full, {md5_list("ids")} AS ids_md5,
       {md5_list("labels")} AS labels_md5
FROM k"""

SHIFT = "list_slice(labels, 2, len(labels))"
SQL["supervision_stats"] = f"""WITH {SFT}
SELECT pos, {n("labels")} AS n_tokens, {SUP} AS n_supervised,
       CAST(len(list_filter({SHIFT}, lambda x: x <> -100)) AS BIGINT) AS n_supervised_shifted,
       len(list_filter({SHIFT}, lambda x: x <> -100)) = 0 AS fully_masked FROM senc"""

SQL["shifted_labels"] = f"""WITH {SFT}
SELECT pos, {n(SHIFT)} AS n_shifted, {md5_list(SHIFT)} AS shifted_md5 FROM senc"""

SQL["plan_sequential"] = f"""WITH {SFT}
SELECT pos, pos AS order_idx, CAST(pos // {C.PLAN_BS} AS BIGINT) AS batch_id FROM senc"""

RANDOM = f"""rnd AS (SELECT *, CAST(row_number() OVER (ORDER BY md5('{C.SEED}:' || CAST(pos AS VARCHAR)), pos) - 1 AS BIGINT) AS order_idx
        FROM senc)"""

SQL["plan_random"] = f"""WITH {SFT}, {RANDOM}
SELECT pos, order_idx, CAST(order_idx // {C.PLAN_BS} AS BIGINT) AS batch_id FROM rnd"""


def _length_grouped() -> str:
    group = C.PLAN_BS * C.PLAN_ACCUM
    mult = f"CASE WHEN least(cnt // {group * 4}, 50) > 0 THEN least(cnt // {group * 4}, 50) ELSE 1 END"
    return f"""{RANDOM},
ms AS (SELECT {mult} * {group} AS size FROM (SELECT count(*) AS cnt FROM senc)),
mg AS (SELECT rnd.*, len(ids) AS nn, order_idx // ms.size AS mega, ms.size FROM rnd, ms),
mk AS (SELECT *, row_number() OVER (PARTITION BY mega ORDER BY nn DESC, order_idx) - 1 AS k FROM mg),
top AS (SELECT mega AS top FROM mk WHERE k = 0 ORDER BY nn DESC, mega LIMIT 1),
lg AS (SELECT pos, nn, CAST(CASE WHEN k = 0 AND mega = 0 THEN top * size WHEN k = 0 AND mega = top THEN 0
                      ELSE mega * size + k END AS BIGINT) AS order_idx FROM mk, top)"""


SQL["plan_length_grouped"] = f"""WITH {SFT}, {_length_grouped()}
SELECT pos, order_idx, CAST(order_idx // {C.PLAN_BS} AS BIGINT) AS batch_id FROM lg"""

PADDED = f"""pb AS (SELECT pos, ids, labels, order_idx, CAST(order_idx // {C.PLAN_BS} AS BIGINT) AS batch_id,
              max(len(ids)) OVER (PARTITION BY order_idx // {C.PLAN_BS}) AS m FROM rnd),
pad AS (SELECT pos, order_idx, batch_id, m AS width,
               list_concat(ids, list_resize(CAST([] AS INTEGER[]), m - len(ids), {C.PAD_ID})) AS pids,
               list_concat(labels, list_resize(CAST([] AS INTEGER[]), m - len(ids), -100)) AS plabels FROM pb)"""

SQL["collate_padded"] = f"""WITH {SFT}, {RANDOM}, {PADDED}
SELECT pos, batch_id, CAST(width AS BIGINT) AS width, {md5_list("pids")} AS ids_md5, {md5_list("plabels")} AS labels_md5,
       CAST(len(list_filter(pids, lambda x: x <> {C.PAD_ID})) AS BIGINT) AS n_attended FROM pad"""


def _padding_stats(order_cte: str, src: str) -> str:
    return f"""WITH {SFT}, {order_cte},
b AS (SELECT CAST(order_idx // {C.PLAN_BS} AS BIGINT) AS batch_id, len(ids) AS nn FROM {src})
SELECT batch_id, count(*) AS rows, CAST(sum(nn) AS BIGINT) AS real_tokens, CAST(count(*) * max(nn) AS BIGINT) AS padded_tokens,
       round(CASE WHEN count(*) * max(nn) = 0 THEN NULL ELSE sum(nn) / (count(*) * max(nn)) END, 6) AS fill
FROM b GROUP BY batch_id"""


SQL["padding_stats_random"] = _padding_stats(RANDOM, "rnd")
SQL["padding_stats_length_grouped"] = _padding_stats(
    _length_grouped(), "(SELECT lg.order_idx, s.ids FROM lg JOIN senc s USING (pos))")

SQL["unpad_offsets"] = f"""WITH {SFT}, {RANDOM}, {PADDED},
u AS (SELECT *, CAST(len(list_filter(pids, lambda x: x <> {C.PAD_ID})) AS BIGINT) AS seqlen,
             CAST(row_number() OVER (PARTITION BY batch_id ORDER BY order_idx) - 1 AS BIGINT) AS row_in_batch FROM pad)
SELECT pos, batch_id, row_in_batch, seqlen,
       CAST(sum(seqlen) OVER (PARTITION BY batch_id ORDER BY order_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - seqlen AS BIGINT) AS cu_offset,
       CAST(max(seqlen) OVER (PARTITION BY batch_id) AS BIGINT) AS max_seqlen,
       {md5_list(f"list_filter(list_transform(range(width), lambda j: CASE WHEN pids[j + 1] <> {C.PAD_ID} THEN row_in_batch * width + j END), lambda v: v IS NOT NULL)")} AS indices_md5
FROM u"""

SQL["cu_seqlens"] = f"""WITH {SFT}, {RANDOM}, {PADDED},
u AS (SELECT batch_id, order_idx, CAST(len(list_filter(pids, lambda x: x <> {C.PAD_ID})) AS BIGINT) AS k FROM pad),
c AS (SELECT batch_id, k, order_idx, CAST(sum(k) OVER (PARTITION BY batch_id ORDER BY order_idx) AS BIGINT) AS e FROM u),
g AS (SELECT batch_id, list_prepend(CAST(0 AS BIGINT), list(e ORDER BY order_idx)) AS cu, max(k) AS max_seqlen, CAST(sum(k) AS BIGINT) AS total
      FROM c GROUP BY batch_id)
SELECT batch_id, {n("cu")} AS n_offsets, {md5_list("cu")} AS cu_md5, max_seqlen, total FROM g"""

SQL["last_token_index"] = f"""WITH {SFT}, {RANDOM}, {PADDED}
SELECT pos, CAST({pmod(f"greatest(coalesce(list_position(pids, {C.PAD_ID}), 0) - 1, 0) - 1", "len(pids)")} AS BIGINT) AS last_idx
FROM pad"""


# --- preference data -------------------------------------------------------------------

PAIRS = f"""u AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS response_chosen FROM conversations WHERE role = 'assistant'),
p0 AS (SELECT conv_id, turn, question, response_chosen,
              md5('{C.SEED}:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)) AS k FROM u JOIN a USING (conv_id, turn)),
p1 AS (SELECT *, row_number() OVER (ORDER BY k, conv_id, turn) - 1 AS pair_id FROM p0),
pairs AS (SELECT x.pair_id, x.conv_id, x.turn, x.question, x.response_chosen, y.response_chosen AS response_rejected
          FROM p1 x JOIN p1 y ON y.pair_id = x.pair_id + 1)"""


def _prompt(name: str, q: str) -> str:
    block = system_block(name)
    return f"{lit(block)} || {fmt_sql(TPL[name][2], q, None)}"


SQL["dpo_prompts"] = f"""WITH {PAIRS},
d AS (SELECT pair_id, {_prompt(C.SFT_TEMPLATE, 'question')} AS prompt, response_chosen AS chosen,
             response_rejected AS rejected FROM pairs)
SELECT pair_id, CAST(length(prompt) AS BIGINT) AS prompt_chars, md5(prompt) AS prompt_md5, md5(chosen) AS chosen_md5,
       md5(rejected) AS rejected_md5
FROM d WHERE length(prompt) + greatest(length(chosen), length(rejected)) <= {C.DPO_MAX_CHARS}
  AND length(prompt) > 0 AND length(chosen) > 0 AND length(rejected) > 0"""

SQL["files_dpo"] = f"""WITH {PAIRS},
d AS (SELECT pair_id, {_prompt(C.SFT_TEMPLATE, 'question')} AS prompt, response_chosen AS chosen,
             response_rejected AS rejected FROM pairs)
SELECT CAST(pair_id // {C.FILE_PAIRS} AS INTEGER) AS file_index, CAST(row_number() OVER (ORDER BY pair_id) - 1 AS BIGINT) AS pos,
       md5(prompt) AS prompt_md5, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5
FROM d WHERE length(prompt) + greatest(length(chosen), length(rejected)) <= {C.DPO_MAX_CHARS}
  AND length(prompt) > 0 AND length(chosen) > 0 AND length(rejected) > 0"""

SQL["dpo_preview"] = f"""WITH {PAIRS},
d AS (SELECT pair_id, {_prompt(C.SFT_TEMPLATE, 'question')} AS prompt, response_chosen AS chosen,
             response_rejected AS rejected FROM pairs),
k AS (SELECT * FROM d WHERE length(prompt) + greatest(length(chosen), length(rejected)) <= {C.DPO_MAX_CHARS}
        AND length(prompt) > 0 AND length(chosen) > 0 AND length(rejected) > 0 ORDER BY pair_id LIMIT 1)
SELECT pair_id, md5(prompt || chosen) AS chosen_md5, md5(prompt || rejected) AS rejected_md5 FROM k"""

_asst = TPL[C.SFT_TEMPLATE][3]
REWARD = f"""{PAIRS},
rt AS (SELECT pair_id, {marker_tokens('nfc_normalize(' + _prompt(C.SFT_TEMPLATE, 'question') + ' || ' + fmt_sql(_asst, 'response_chosen') + ')')} AS tc,
              {marker_tokens('nfc_normalize(' + _prompt(C.SFT_TEMPLATE, 'question') + ' || ' + fmt_sql(_asst, 'response_rejected') + ')')} AS tr
       FROM pairs),
rc AS (SELECT pair_id, tc AS tokens FROM rt),
rr AS (SELECT pair_id, tr AS tokens FROM rt),
rex AS (SELECT token FROM (SELECT unnest(tc) AS token FROM rt UNION ALL SELECT unnest(tr) AS token FROM rt)),
rvocab AS (SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) - 1 AS INTEGER) AS id
           FROM (SELECT token, count(*) AS cnt FROM rex GROUP BY token)),
enc AS (SELECT pair_id, side, list(v.id ORDER BY i) AS ids FROM (
          SELECT pair_id, 'c' AS side, i, tc[i + 1] AS token FROM (SELECT *, unnest(range(len(tc))) AS i FROM rt)
          UNION ALL
          SELECT pair_id, 'r' AS side, i, tr[i + 1] AS token FROM (SELECT *, unnest(range(len(tr))) AS i FROM rt)) x
        JOIN rvocab v USING (token) GROUP BY pair_id, side),
w AS (SELECT rt.pair_id, coalesce(c.ids, CAST([] AS INTEGER[])) AS ic, coalesce(r.ids, CAST([] AS INTEGER[])) AS ir FROM rt
      LEFT JOIN enc c ON c.pair_id = rt.pair_id AND c.side = 'c' LEFT JOIN enc r ON r.pair_id = rt.pair_id AND r.side = 'r')"""

SQL["reward_tokens"] = f"""WITH {REWARD}
SELECT pair_id, {n("ic")} AS n_chosen, {n("ir")} AS n_rejected, {md5_list("ic")} AS chosen_md5, {md5_list("ir")} AS rejected_md5,
       {n("ic")} AS mask_chosen
FROM w WHERE len(ic) <= {C.REWARD_MAX_LEN} AND len(ir) <= {C.REWARD_MAX_LEN}"""

SQL["files_reward"] = f"""WITH {REWARD}
SELECT CAST(pair_id // {C.FILE_PAIRS} AS INTEGER) AS file_index, CAST(row_number() OVER (ORDER BY pair_id) - 1 AS BIGINT) AS pos,
       {md5_list("ic")} AS chosen_md5, {md5_list("ir")} AS rejected_md5
FROM w WHERE len(ic) <= {C.REWARD_MAX_LEN} AND len(ir) <= {C.REWARD_MAX_LEN}"""

SQL["reward_preview"] = f"""WITH {REWARD},
fr AS (SELECT pair_id, ic FROM w WHERE len(ic) <= {C.REWARD_MAX_LEN} AND len(ir) <= {C.REWARD_MAX_LEN}
       ORDER BY pair_id LIMIT 1),
fx AS (SELECT pair_id, i, ic[i + 1] AS id FROM (SELECT pair_id, ic, unnest(range(len(ic))) AS i FROM fr))
SELECT pair_id, string_agg(v.token, ' ' ORDER BY fx.i) AS preview FROM fx JOIN rvocab v USING (id) GROUP BY pair_id"""

SQL["scoring_prompts"] = f"""WITH {PAIRS},
st AS (SELECT pair_id, {marker_tokens('nfc_normalize(' + _prompt(C.SFT_TEMPLATE, 'question') + ' || ' + fmt_sql(_asst, 'response_chosen') + ')')} AS tokens FROM pairs),
{encode_ctes("st", "pair_id", "q")}
SELECT pair_id, CAST(least(len(ids), {C.SCORING_LEN}) AS BIGINT) AS n_tokens, {md5_list(f"list_slice(ids, 1, {C.SCORING_LEN})")} AS ids_md5
FROM qenc"""

JSONL = "to_json({'instruction': question, 'input': '', 'output': response_chosen})"
SQL["instructions_jsonl"] = f"""WITH {PAIRS}
SELECT pair_id AS id, md5({JSONL}) AS line_md5 FROM pairs"""

_truthy = """CASE json_type(line, '$.output')
  WHEN 'VARCHAR' THEN length(json_extract_string(line, '$.output')) > 0
  WHEN 'BOOLEAN' THEN json_extract_string(line, '$.output') = 'true'
  WHEN 'BIGINT' THEN CAST(json_extract_string(line, '$.output') AS DOUBLE) <> 0
  WHEN 'UBIGINT' THEN CAST(json_extract_string(line, '$.output') AS DOUBLE) <> 0
  WHEN 'DOUBLE' THEN CAST(json_extract_string(line, '$.output') AS DOUBLE) <> 0
  WHEN 'ARRAY' THEN json_array_length(line, '$.output') > 0
  WHEN 'OBJECT' THEN len(json_keys(line, '$.output')) > 0
  ELSE false END"""
SQL["instructions_valid"] = f"""WITH {PAIRS}, l AS (SELECT pair_id AS id, {JSONL} AS line FROM pairs)
SELECT id, coalesce(list_contains(json_keys(line), 'instruction') AND list_contains(json_keys(line), 'input')
                    AND list_contains(json_keys(line), 'output') AND ({_truthy}), false) AS valid FROM l"""


_kinds = ['""', "null", "0", '"0"', "0.0", "false", "true", "[]", "[0]", "{}", '{"a":null}', "-1"]
_broken = " ".join(f"WHEN {4 + i} THEN substr(r, 1, length(r) - 1) || {lit(',"output":' + k + '}')}" for i, k in enumerate(_kinds))
SQL["instructions_checked"] = f"""WITH {PAIRS},
j AS (SELECT pair_id AS id, CAST(to_json({{'instruction': question, 'input': ''}}) AS VARCHAR) AS r,
             CAST({JSONL} AS VARCHAR) AS w, CAST(to_json({{'input': '', 'output': response_chosen}}) AS VARCHAR) AS no_instruction FROM pairs),
t AS (SELECT id, CASE id % {2 * len(_kinds) + 4} WHEN 0 THEN r WHEN 1 THEN substr(w, 1, length(w) - 5) WHEN 2 THEN no_instruction
             WHEN 3 THEN '[' || w || ']' {_broken} ELSE w END AS text FROM j),
l AS (SELECT id, CASE WHEN json_valid(text) AND json_type(text) = 'OBJECT' THEN text ELSE '{{}}' END AS line FROM t)
SELECT id, coalesce(list_contains(json_keys(line), 'instruction') AND list_contains(json_keys(line), 'input')
                    AND list_contains(json_keys(line), 'output') AND ({_truthy}), false) AS valid FROM l"""


# --- mixing -------------------------------------------------------------------------------

MIX = f"""docs AS (SELECT source, doc_id AS id FROM documents),
props AS (SELECT source, list_extract(CAST([0.0, 0.25, 0.29, 0.5, 1.0] AS DOUBLE[]), (k % 5) + 1) AS ratio
          FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k FROM (SELECT DISTINCT source FROM docs))),
sh AS (SELECT source, id, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('{C.SEED}:' || source || ':' || CAST(id AS VARCHAR)), id) - 1 AS BIGINT) AS r,
              count(*) OVER (PARTITION BY source) AS n_source FROM docs),
q AS (SELECT sh.*, CAST(trunc(n_source * ratio) AS BIGINT) AS num FROM sh JOIN props USING (source)),
off AS (SELECT 0 AS epoch, source, num, n_source, CAST(0 AS BIGINT) AS start
        FROM (SELECT DISTINCT source, num, n_source FROM q WHERE num > 0)
        UNION ALL
        SELECT epoch + 1, source, num, n_source,
               CASE WHEN start + num > n_source THEN num - (n_source - start) ELSE start + num END
        FROM off WHERE epoch + 1 < {C.MIX_EPOCHS}),
mixed AS (SELECT CAST(epoch AS BIGINT) AS epoch, source, q.id, q.r, q.num, q.n_source, q.r < start + q.num - q.n_source AS wrapped
          FROM off JOIN q USING (source)
          WHERE (q.r >= start AND q.r < start + q.num) OR q.r < start + q.num - q.n_source)"""

SQL["mix_proportions"] = f"""WITH RECURSIVE {MIX} SELECT source, ratio FROM props"""
SQL["mix_shuffled_sources"] = f"""WITH RECURSIVE {MIX} SELECT source, id, r, n_source FROM sh"""
SQL["mix_epochs"] = f"""WITH RECURSIVE {MIX} SELECT epoch, source, id, r, num, wrapped FROM mixed"""
SQL["mix_epoch_order"] = f"""WITH RECURSIVE {MIX}
SELECT CAST(row_number() OVER (ORDER BY epoch, md5('{C.SEED}:' || CAST(epoch AS VARCHAR) || ':' || source || ':' || CAST(id AS VARCHAR)), source, id) - 1 AS BIGINT) AS out_pos,
       epoch, source, id FROM mixed"""
SQL["mix_report"] = f"""WITH RECURSIVE {MIX}
SELECT epoch, source, count(*) AS rows, CAST(sum(CAST(wrapped AS BIGINT)) AS BIGINT) AS reused FROM mixed GROUP BY epoch, source"""


def permuted_ctes(src: str, name: str) -> str:
    """``src`` has px (place), pn (how many) and pk (round keys); ``name`` adds py, the permuted place."""
    from tessera.operators.permute import FACTORS, PRIME

    def scrambled(v: str) -> str:
        t = f"(({v} * {FACTORS[0]} + k) % {PRIME})"
        return f"((xor({t}, {t} >> 13) * {FACTORS[1]} + k) % {PRIME})"

    def walk(p: str) -> str:
        left, right = "(w // gb)", "(w % gb)"
        return (f"list_reduce(list_prepend({p}, pk), lambda w, k, i: CASE WHEN i % 2 = 0 "
                f"THEN (({left} + {scrambled(right)}) % ga) * gb + {right} "
                f"ELSE {left} * gb + ({right} + {scrambled(left)}) % gb END)")

    return f"""
{name}g AS (SELECT *, greatest(CAST(ceil(sqrt(pn)) AS BIGINT), 1) AS ga FROM {src}),
{name}h AS (SELECT *, greatest(CAST(ceil(pn / ga) AS BIGINT), 1) AS gb FROM {name}g),
{name} AS (SELECT * EXCLUDE (ga, gb, px, pn, pk), list_reduce(list_prepend({walk("px")}, range(64)),
                  lambda p, z: CASE WHEN p < pn THEN p ELSE {walk("p")} END) AS py FROM {name}h)"""


def keys_sql(seed: str) -> str:
    return f"list_transform(range(6), lambda i: CAST('0x' || substr(md5({seed} || ':perm:' || i), 1, 7) AS BIGINT))"


def mixed_ctes(lines: str, ratio: str) -> str:
    """``lines`` has source, id and place (in the source), ``ratio`` source and ratio; defines mxo with out_pos."""
    return f"""
mxn AS (SELECT *, count(*) OVER (PARTITION BY source) AS n_source FROM {lines}),
mxr AS (SELECT m.*, CAST(trunc(n_source * ratio) AS BIGINT) AS num FROM mxn m JOIN {ratio} USING (source)),
mxs AS (SELECT source, num, coalesce(sum(num) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
               sum(num) OVER () AS total FROM (SELECT DISTINCT source, num FROM mxr)),
mxp AS (SELECT m.*, CAST(off AS BIGINT) AS off, CAST(total AS BIGINT) AS total, place AS px, n_source AS pn,
               {keys_sql(f"'{C.SEED}:' || source")} AS pk FROM mxr m JOIN mxs USING (source) WHERE m.num > 0),
{permuted_ctes("mxp", "mxq")},
mxe AS (SELECT q.* EXCLUDE (py), e AS epoch, ((py - e * num) % n_source + n_source) % n_source AS j FROM mxq q, range({C.MIX_EPOCHS}) t(e)),
mxf AS (SELECT *, off + j AS px, total AS pn, {keys_sql(f"'{C.SEED}:epoch:' || epoch")} AS pk FROM mxe WHERE j < num),
{permuted_ctes("mxf", "mxz")},
mxo AS (SELECT *, CAST(epoch * total + py AS BIGINT) AS out_pos FROM mxz)"""


SQL["plan_permuted"] = f"""WITH p AS (SELECT doc_id AS pos, doc_id AS px, count(*) OVER () AS pn, {keys_sql(f"'{C.SEED}'")} AS pk FROM documents),
{permuted_ctes("p", "q")}
SELECT pos, py AS order_idx, CAST(py // {C.PLAN_BS} AS BIGINT) AS batch_id FROM q"""

SQL["mix_permuted"] = f"""WITH RECURSIVE {MIX},
ln AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS place FROM docs),
{mixed_ctes("ln", "props")}
SELECT out_pos, CAST(epoch AS BIGINT) AS epoch, source, id FROM mxo"""

SQL["mixture_lines"] = f"""WITH {PAIRS},
ln AS (SELECT 'source=s' || (pair_id % 4) AS source, pair_id AS id, md5(CAST({JSONL} AS VARCHAR)) AS line_md5,
              row_number() OVER (PARTITION BY pair_id % 4 ORDER BY pair_id) - 1 AS place FROM pairs),
rt AS (SELECT unnest([{", ".join(f"'source=s{i}'" for i in range(4))}]) AS source,
              unnest([{", ".join(f"CAST({r} AS DOUBLE)" for r in C.MIX_RATIOS)}]) AS ratio),
{mixed_ctes("ln", "rt")}
SELECT out_pos, line_md5 FROM mxo"""


# --- preference metrics ------------------------------------------------------------------

TOKLOGP = f"""{PAIRS},
ct AS (SELECT role, unnest(regexp_extract_all(text, {lit(P)})) AS token FROM conversations),
pc AS (SELECT token, count(*) AS c FROM ct WHERE role = 'assistant' GROUP BY token),
pdn AS (SELECT sum(c) + count(*) AS d FROM pc),
pol AS (SELECT token, ln((c + 1) / d) AS lp FROM pc, pdn),
rc AS (SELECT token, count(*) AS c FROM ct GROUP BY token),
rdn AS (SELECT sum(c) + count(*) AS d FROM rc),
ref AS (SELECT token, ln((c + 1) / d) AS lp FROM rc, rdn),
sides AS (SELECT pair_id, 'chosen' AS side, 0 AS k, question, response_chosen AS resp FROM pairs
          UNION ALL SELECT pair_id, 'rejected' AS side, 1 AS k, question, response_rejected AS resp FROM pairs),
seq AS (SELECT pair_id * 2 + k AS seq_id, pair_id, side, list_concat(q, a) AS tokens,
               list_concat(list_resize(CAST([] AS INTEGER[]), len(q), -100), list_transform(a, lambda t: CAST(length(t) AS INTEGER))) AS labels
        FROM (SELECT *, regexp_extract_all(question, {lit(P)}) AS q, regexp_extract_all(resp, {lit(P)}) AS a FROM sides)),
tk AS (SELECT seq_id, pair_id, side, i AS tok_pos, tokens[i + 1] AS token, labels[i + 1] AS label
       FROM (SELECT *, unnest(range(len(tokens))) AS i FROM seq)),
tl AS (SELECT tk.seq_id, tk.pair_id, tk.side, tk.tok_pos, tk.label,
              coalesce(pol.lp, ln(1.0 / (SELECT d FROM pdn))) AS logp, coalesce(ref.lp, ln(1.0 / (SELECT d FROM rdn))) AS ref_logp
       FROM tk LEFT JOIN pol USING (token) LEFT JOIN ref USING (token))"""

MASK = "(tok_pos >= 1 AND label <> -100)"


def _seq(value: str, average: bool) -> str:
    s = f"sum(CASE WHEN {MASK} THEN {value} ELSE 0.0 END)"
    cnt = f"sum(CAST({MASK} AS BIGINT))"
    return f"CASE WHEN {cnt} = 0 THEN NULL ELSE {s} / {cnt} END" if average else s


def _wide(average: bool) -> str:
    return f"""sq AS (SELECT pair_id, side, CAST(sum(CAST({MASK} AS BIGINT)) AS BIGINT) AS nc, {_seq('logp', average)} AS lp,
                    {_seq('ref_logp', average)} AS rp FROM tl GROUP BY seq_id, pair_id, side),
wide AS (SELECT pair_id, max(CASE WHEN side = 'chosen' THEN lp END) AS pc, max(CASE WHEN side = 'rejected' THEN lp END) AS pr,
                max(CASE WHEN side = 'chosen' THEN rp END) AS rc, max(CASE WHEN side = 'rejected' THEN rp END) AS rr,
                max(CASE WHEN side = 'chosen' THEN nc END) AS n_chosen, max(CASE WHEN side = 'rejected' THEN nc END) AS n_rejected
         FROM sq GROUP BY pair_id)"""


SQL["sequence_logps"] = f"""WITH {TOKLOGP}
SELECT seq_id, pair_id, side, CAST(sum(CAST({MASK} AS BIGINT)) AS BIGINT) AS n_completion, {r6(_seq('logp', False))} AS seq_logp
FROM tl GROUP BY seq_id, pair_id, side"""

SQL["pair_logps"] = f"""WITH {TOKLOGP}, {_wide(False)}
SELECT pair_id, n_chosen, n_rejected, {r6('pc')} AS policy_chosen, {r6('pr')} AS policy_rejected,
       {r6('rc')} AS reference_chosen, {r6('rr')} AS reference_rejected FROM wide"""


def logsig(x: str) -> str:
    return f"(least({x}, 0.0) - ln(1.0 + exp(-abs({x}))))"


B = C.BETA


def _loss_select(kind: str) -> str:
    if kind == "sigmoid":
        src = "wide"
        loss = f"-{logsig(f'{B} * ((pc - pr) - (rc - rr))')}"
        cr, rj = f"{B} * (pc - rc)", f"{B} * (pr - rr)"
    elif kind == "ipo":
        src = ("(SELECT pair_id, CASE WHEN n_chosen = 0 THEN NULL ELSE pc / n_chosen END AS pc, "
               "CASE WHEN n_rejected = 0 THEN NULL ELSE pr / n_rejected END AS pr, "
               "CASE WHEN n_chosen = 0 THEN NULL ELSE rc / n_chosen END AS rc, "
               "CASE WHEN n_rejected = 0 THEN NULL ELSE rr / n_rejected END AS rr FROM wide)")
        loss = f"pow(((pc - pr) - (rc - rr)) - {1.0 / (2.0 * B)}, 2)"
        cr, rj = f"{B} * (pc - rc)", f"{B} * (pr - rr)"
    elif kind == "simpo":
        src = "wide"
        loss = f"-{logsig(f'{B} * (pc - pr) - {C_GAMMA}')}"
        cr, rj = f"{B} * pc", f"{B} * pr"
    elif kind == "orpo":
        src = "wide"
        loss = f"-{B} * {logsig('(pc - pr) - (ln(1.0 - exp(pc)) - ln(1.0 - exp(pr)))')}"
        cr, rj = f"{B} * pc", f"{B} * pr"
    else:
        raise ValueError(kind)
    return f"SELECT pair_id, {loss} AS loss, {cr} AS chosen_reward, {rj} AS rejected_reward, pc, pr FROM {src}"


from tessera.operators.preference import SIMPO_GAMMA as C_GAMMA  # noqa: E402


def _losses_sql(kind: str, dro: bool = False) -> str:
    average = dro or kind in ("ipo", "simpo", "orpo")
    return f"""WITH {TOKLOGP}, {_wide(average)}, l AS ({_loss_select(kind)})"""


for _kind, _q in (("sigmoid", "dpo_losses"), ("ipo", "ipo_losses"), ("simpo", "simpo_losses"), ("orpo", "orpo_losses")):
    SQL[_q] = _losses_sql(_kind) + f"""
SELECT pair_id, {r6('loss')} AS loss, {r6('chosen_reward')} AS chosen_reward, {r6('rejected_reward')} AS rejected_reward FROM l"""

SQL["preference_metrics"] = _losses_sql("sigmoid") + f"""
SELECT {r6('avg(chosen_reward)')} AS eval_rewards_chosen, {r6('avg(rejected_reward)')} AS eval_rewards_rejected,
       {r6('avg(CAST(chosen_reward > rejected_reward AS DOUBLE))')} AS eval_rewards_accuracies,
       {r6('avg(chosen_reward - rejected_reward)')} AS eval_rewards_margins,
       {r6('avg(pr)')} AS eval_logps_rejected, {r6('avg(pc)')} AS eval_logps_chosen, {r6('avg(loss)')} AS eval_loss FROM l"""

_W = C.DRO_WEIGHT
# log-probs are averages, not sums, as soon as the robust objective is on
SQL["dro_loss"] = _losses_sql("sigmoid", dro=True) + f""",
mx AS (SELECT max(-loss / {_W}) AS m FROM l)
SELECT {r6(f'-{_W} * (m + ln(avg(exp(-loss / {_W} - m))))')} AS dro_loss FROM l, mx GROUP BY m"""

SQL["token_nll"] = f"""WITH {TOKLOGP},
nl AS (SELECT -avg(logp) AS nll, count(*) AS n_tokens FROM tl WHERE {MASK} AND side = 'chosen')
SELECT {r6('nll')} AS nll, n_tokens, {r6('exp(nll)')} AS perplexity FROM nl"""

SQL["reward_scores"] = f"""WITH {TOKLOGP}, {_wide(True)},
sc AS (SELECT pair_id, pc - pr AS logit FROM wide),
mse AS (SELECT avg(pow(logit - 1.0, 2)) AS mse_all FROM sc)
SELECT pair_id, {r6('logit')} AS logit, {r6('1.0 / (1.0 + exp(-logit))')} AS score, {r6('mse_all')} AS mse_all FROM sc, mse"""

NLL = f"nl AS (SELECT -avg(logp) AS nll FROM tl WHERE {MASK} AND side = 'chosen')"
RPO = _losses_sql("sigmoid") + f""", {NLL},
w AS (SELECT pair_id, loss + {C.RPO_ALPHA} * nll AS loss, chosen_reward, rejected_reward, pc, pr, nll FROM l, nl)"""

SQL["rpo_losses"] = RPO + f"""
SELECT pair_id, {r6('loss')} AS loss, {r6('chosen_reward')} AS chosen_reward, {r6('rejected_reward')} AS rejected_reward FROM w"""

SQL["rpo_metrics"] = RPO + f"""
SELECT {r6('avg(chosen_reward)')} AS rewards_chosen, {r6('avg(rejected_reward)')} AS rewards_rejected,
       {r6('avg(CAST(chosen_reward > rejected_reward AS DOUBLE))')} AS rewards_accuracies,
       {r6('avg(chosen_reward - rejected_reward)')} AS rewards_margins, {r6('avg(pr)')} AS logps_rejected,
       {r6('avg(pc)')} AS logps_chosen, {r6('avg(loss)')} AS loss, {r6('avg(nll)')} AS nll_loss FROM w"""

SQL["cpo_objectives"] = f"""WITH {TOKLOGP}, {_wide(True)}, {NLL},
l AS (SELECT 'simpo' AS kind, loss FROM ({_loss_select("simpo")})
      UNION ALL SELECT 'orpo', loss FROM ({_loss_select("orpo")})),
m AS (SELECT kind, 'mean' AS reduction, avg(loss) AS v FROM l GROUP BY kind
      UNION ALL SELECT kind, 'robust', -{_W} * ln(avg(exp(-loss / {_W}))) FROM l GROUP BY kind)
SELECT kind, reduction, {r6('v')} AS preference_loss, {r6('nll')} AS nll_loss,
       {r6(f'v + {C.CPO_ALPHA} * nll')} AS objective FROM m, nl"""

SQL["reward_pair_losses"] = f"""WITH {TOKLOGP}, {_wide(True)}
SELECT pair_id, {r6('-' + logsig('(pc - pr)'))} AS loss, {r6('pc')} AS chosen_reward, {r6('pr')} AS rejected_reward FROM wide"""

SQL["reference_logps"] = f"""WITH {TOKLOGP}, {_wide(False)}
SELECT pair_id, {r6('CASE WHEN pair_id % 2 = 0 AND pair_id % 10 <> 0 THEN rc - 1 ELSE rc END')} AS reference_chosen,
       {r6('CASE WHEN pair_id % 2 = 0 AND pair_id % 10 <> 0 THEN rr - 1 ELSE rr END')} AS reference_rejected,
       CAST(CASE WHEN pair_id % 2 = 0 AND pair_id % 10 <> 0 THEN 0 ELSE 1 END AS INTEGER) AS version FROM wide"""

SQL["score_losses"] = f"""WITH {TOKLOGP}, {_wide(True)}
SELECT {r6('avg(pow(pc - pr - 1.0, 2))')} AS mse, {r6('avg(-' + logsig('(pc - pr)') + ')')} AS bce FROM wide"""

LOGITS = """lg AS (SELECT doc_id, n_chars, [(length(text) - length(replace(text, v, ''))) / 10.0 - 3 FOR v IN ['a', 'e', 'i', 'o', 'u']] AS x,
             [(doc_id // (1 << i)) % 2 FOR i IN range(5)] AS t FROM documents),
ce AS (SELECT doc_id, CASE WHEN n_chars % 6 = 5 THEN NULL ELSE list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x)))))
              - x[n_chars % 6 + 1] END AS loss FROM lg),
bc AS (SELECT doc_id, list_sum(list_transform(range(5), lambda i: greatest(x[i + 1], 0.0) - x[i + 1] * t[i + 1]
              + ln(1.0 + exp(-abs(x[i + 1]))))) / 5 AS loss FROM lg)"""
SQL["class_cross_entropy"] = f"WITH {LOGITS} SELECT doc_id, {r6('loss')} AS loss FROM ce"
SQL["multilabel_bce"] = f"WITH {LOGITS} SELECT doc_id, {r6('loss')} AS loss FROM bc"
SQL["classifier_losses"] = f"""WITH {LOGITS},
rg AS (SELECT pow(x[1] - CASE WHEN n_chars % 6 = 5 THEN -100 ELSE n_chars % 6 END, 2) AS loss FROM lg),
a AS (SELECT 'regression' AS problem, avg(loss) AS v, count(loss) AS n FROM rg
      UNION ALL SELECT 'single_label', avg(loss), count(loss) FROM ce UNION ALL SELECT 'multi_label', avg(loss), count(loss) FROM bc)
SELECT problem, round(v, 4) AS loss, n FROM a"""

try:
    SQL |= _bpe_sql()
except ModuleNotFoundError as e:     # the public tokeniser files are an installed package
    if e.name != "public_tokenizers":
        raise
