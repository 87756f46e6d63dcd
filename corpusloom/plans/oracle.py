"""The SQL each query is checked against, by name. It is DuckDB's, over the same Parquet tables."""

SQL: dict[str, str] = {}

SPECIAL = r"<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|<\|reserved_(?:1?[0-9]|2[0-8])\|>"
DOCS = "d AS (SELECT doc_id, lower(trim(source)) AS config, text, dataset_name, shard, octet_length(encode(text)) AS nb FROM documents WHERE text IS NOT NULL)"
POOL = f"{DOCS}, laid AS (SELECT doc_id, text, nb + 3 AS n_tokens, row_number() OVER w - 1 AS rank, coalesce(sum(nb + 3) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM d WINDOW w AS (ORDER BY md5(concat_ws('|', '42', 'pool', doc_id)), doc_id))"
LEN = POOL + ", len AS (SELECT doc_id, rank, off + 1 AS start, n_tokens - CASE WHEN rank = (SELECT max(rank) FROM laid) THEN 1 ELSE 0 END AS n FROM laid)"
BYTE = "(CASE WHEN b BETWEEN 33 AND 126 THEN b - 1 WHEN b BETWEEN 161 AND 172 THEN b - 35 WHEN b BETWEEN 174 AND 255 THEN b - 36 WHEN b <= 32 THEN 220 + b WHEN b <= 160 THEN 126 + b ELSE 287 END)"
TOKENS = f"""{POOL}, hexed AS (SELECT doc_id, off, hex(encode(text)) AS h, n_tokens - 3 AS nb FROM laid),
bytes AS (SELECT doc_id, off + 3 + i AS pos, ('0x' || substr(h, 2 * i + 1, 2))::INT AS b FROM (SELECT doc_id, off, h, unnest(range(nb)) AS i FROM hexed)),
tok AS (SELECT doc_id, pos, {BYTE} AS t FROM bytes UNION ALL SELECT doc_id, off + k, CASE k WHEN 1 THEN 0 ELSE 230 END FROM laid, (SELECT unnest([0, 1, 2]) AS k))"""
WINDOW = f"""{TOKENS}, win AS (SELECT pos // 512 AS win, pos, t, sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY pos // 512 ORDER BY pos) AS g, lead(t) OVER (ORDER BY pos) AS y FROM tok),
top AS (SELECT (max(pos) + 1 - 1) // 512 AS nw FROM tok)"""
CONV = """c AS (SELECT conv_id, messages FROM conversations WHERE messages IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY received_at) = 1),
m AS (SELECT conv_id, array_to_string([coalesce(x.content, '') FOR x IN messages IF x.role = 'system'], chr(10) || chr(10)) AS sys, [{'role': x.role, 'content': coalesce(x.content, '')} FOR x IN messages IF x.role IN ('user', 'assistant')] AS t FROM c),
f AS (SELECT conv_id, CASE WHEN sys <> '' AND len(t) > 0 AND t[1].role = 'user' THEN list_prepend({'role': 'user', 'content': sys || chr(10) || chr(10) || t[1].content}, t[2:]) ELSE t END AS turns FROM m)"""
STRIP = f"list_reduce(list_prepend({{0}}, [''  FOR q IN range((length({{0}}) - length(replace({{0}}, '|>', ''))) // 2 + 1)]), lambda a, q: regexp_replace(a, '{SPECIAL}', '', 'g'))"
TURN = f"""{CONV}, u0 AS (SELECT conv_id, len(turns) AS n, generate_subscripts(turns, 1) - 1 AS i, unnest(turns) AS x FROM f),
u AS (SELECT conv_id, n, i, x.role AS role, {STRIP.format('x.content')} AS content FROM u0)"""
PAIRS = TURN + """, lens AS (SELECT conv_id, n, i, role, octet_length(encode(content)) + octet_length(encode(role)) + 4 AS k, octet_length(encode(role)) + 2 AS head FROM u),
p AS (SELECT conv_id, i // 2 AS pair, sum(k) AS n_tokens, max(CASE WHEN i % 2 = 0 THEN k END) AS n_first, max(CASE WHEN i % 2 = 0 AND role = 'assistant' THEN head END) AS ta,
  max(CASE WHEN i % 2 = 1 AND role = 'assistant' THEN head END) AS tb FROM lens WHERE n >= 2 AND i // 2 < n // 2 GROUP BY 1, 2),
r AS (SELECT conv_id, pair, n_tokens, 1 + n_tokens AS cur, 0 AS chunk FROM p WHERE pair = 0
  UNION ALL SELECT p.conv_id, p.pair, p.n_tokens, CASE WHEN r.cur + p.n_tokens > 2048 THEN 1 + p.n_tokens ELSE r.cur + p.n_tokens END, r.chunk + CASE WHEN r.cur + p.n_tokens > 2048 THEN 1 ELSE 0 END
  FROM r JOIN p ON p.conv_id = r.conv_id AND p.pair = r.pair + 1)"""
EXAMPLES = PAIRS + """, ats AS (SELECT p.*, r.chunk, 1 + coalesce(sum(p.n_tokens) OVER (PARTITION BY p.conv_id, chunk ORDER BY p.pair ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM p JOIN r USING (conv_id, pair)),
g AS (SELECT conv_id, chunk, 1 + sum(n_tokens) AS whole, sum(coalesce(greatest(0, least(a + n_first, 2048) - (a + ta)), 0) + coalesce(greatest(0, least(a + n_tokens, 2048) - (a + n_first + tb)), 0)) AS n_target FROM ats GROUP BY 1, 2),
ex AS (SELECT conv_id, chunk::BIGINT AS chunk, least(whole, 2048)::BIGINT AS n_tokens, n_target::BIGINT AS n_target, whole > 2048 AND n_target > 0 AS truncated, whole > 2048 AND n_target = 0 AS dropped FROM g)"""
INDEX = LEN + """, hist AS (SELECT n, count(*) AS c FROM len GROUP BY 1), cum AS (SELECT n, c, sum(c) OVER (ORDER BY n) AS upto FROM hist),
st AS (SELECT sum(c) AS total, max(n) AS longest FROM hist),
marks AS (SELECT unnest([256, 512, 1024, 2048, 3072, 4096, 6144, 8192, 12288, 16384, 24576, 32768])::BIGINT AS t
  UNION SELECT n FROM (SELECT least(total - 1, floor(total * q / 128)) AS k0 FROM st, range(129) x(q)) JOIN cum ON upto > k0 AND upto - c <= k0
  UNION SELECT least(longest, floor(32768 * pow(2.0, k / 2.0)))::BIGINT FROM st, range(1, 65) y(k) WHERE longest > 32768),
idx AS (SELECT t AS min_tokens, (1 + coalesce(sum(c * n), 0))::BIGINT AS token_offset, coalesce(sum(c), 0)::BIGINT AS doc_offset FROM marks LEFT JOIN hist ON n < t GROUP BY 1)"""
RUNS = "h AS (SELECT * FROM run_history WHERE run_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY started_at NULLS LAST, updates DESC NULLS LAST) = 1)"

MIX = f"""{DOCS}, pt AS (SELECT spec_name, part_no, dataset_name, lower(trim(config)) AS config, cap, n_val_docs, n_train_docs FROM source_parts JOIN source_specs USING (spec_name) WHERE weight IS NOT NULL),
pr AS (SELECT spec_name, part_no, doc_id, cap, n_val_docs, n_train_docs, row_number() OVER (PARTITION BY spec_name, part_no ORDER BY md5(concat_ws('|', '42', 'part', spec_name, part_no, doc_id)), doc_id) - 1 AS rank FROM d JOIN pt USING (dataset_name, config)),
pk AS (SELECT * FROM pr WHERE cap IS NULL OR rank < cap),
po AS (SELECT spec_name, doc_id, coalesce(n_val_docs, 0) AS n_val, n_train_docs, row_number() OVER (PARTITION BY spec_name ORDER BY md5(concat_ws('|', '42', 'pool', spec_name, doc_id)), doc_id) - 1 AS pos FROM pk)"""

SQL["scan_documents"] = "SELECT doc_id, source, n_chars FROM documents WHERE source IS NOT NULL"
SQL["list_splits"] = "SELECT lower(trim(source)) AS config, split, count(*) AS n_rows FROM documents GROUP BY 1, 2"
SQL["shard_names"] = "SELECT i AS shard_no, printf('web-dedup/train-%05d-of-%05d.parquet', i, 104) AS name FROM range(16) t(i)"
SQL["part_cap"] = f"WITH {MIX} SELECT spec_name, part_no::BIGINT AS part_no, doc_id, rank FROM pk"
SQL["part_union"] = f"""WITH {DOCS}, parts AS (SELECT spec_name, part_no, dataset_name, lower(trim(config)) AS config, cap FROM source_parts JOIN source_specs USING (spec_name) WHERE weight IS NOT NULL),
r AS (SELECT spec_name, config, cap, row_number() OVER (PARTITION BY spec_name, part_no ORDER BY md5(concat_ws('|', '42', 'union', spec_name, doc_id)), doc_id) - 1 AS rank FROM d JOIN parts USING (dataset_name, config))
SELECT spec_name, count(*) AS n_rows, count(DISTINCT config) AS n_parts FROM r WHERE cap IS NULL OR rank < cap GROUP BY 1"""
SQL["pool_order"] = f"WITH {POOL} SELECT doc_id, rank FROM laid"
SQL["train_val_split"] = f"WITH {MIX} SELECT spec_name, doc_id, CASE WHEN pos < n_val THEN 'val' ELSE 'train' END AS part FROM po WHERE n_train_docs IS NULL OR pos < n_val + n_train_docs"
SQL["tokenizer_sample"] = f"WITH {MIX} SELECT spec_name, doc_id FROM po WHERE pos >= n_val AND pos < n_val + 10000"
FINGER = "(SELECT substr(sha256('29' || chr(10) || '<|endoftext|>=0' || chr(10) || '<|im_end|>=2' || chr(10) || '<|im_start|>=1' || chr(10) || string_agg((32 + k)::VARCHAR || '=' || lower(printf('%02x', b)), chr(10) ORDER BY k)), 1, 8) FROM (SELECT b, row_number() OVER (ORDER BY NOT (b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174), b) - 1 AS k FROM range(256) r(b)))"
SQL["corpus_meta"] = f"""WITH {DOCS} SELECT sum(nb + 3)::BIGINT AS n_tokens, sum(nb + 3)::BIGINT AS n_real_tokens, 0::BIGINT AS n_pad_tokens, sum(nb + 15)::BIGINT AS n_bytes, round(sum(nb + 3) / sum(nb + 15), 6) AS tokens_per_byte, 288::BIGINT AS vocab_size, {FINGER} AS tokenizer_fingerprint,
0::BIGINT AS sep_id, round(count(*) / sum(nb + 3), 6) AS sep_frac, count(*) AS n_examples, 0::BIGINT AS n_dropped, 0::BIGINT AS n_dropped_tokens, 0::BIGINT AS n_truncated, false AS has_target, false AS has_start, 'flat' AS pack FROM d"""
SQL["render_pretrain"] = f"WITH {TOKENS} SELECT doc_id, count(*) AS n, md5(string_agg(t::VARCHAR, ',' ORDER BY pos)) AS ids_md5 FROM tok GROUP BY 1"
SQL["doc_lengths"] = f"WITH {LEN} SELECT doc_id, rank, start::BIGINT AS start, n FROM len"
SQL["token_histogram"] = f"WITH {TOKENS} SELECT t::INT AS token, count(*) AS n FROM tok GROUP BY 1"
SQL["sort_by_length"] = f"WITH {LEN} SELECT doc_id, n, row_number() OVER w - 1 AS new_rank, (1 + coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS new_start FROM len WINDOW w AS (ORDER BY n, rank)"
SQL["sort_verify"] = f"""WITH {LEN}, s AS (SELECT n, row_number() OVER w AS k, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS pos FROM len WINDOW w AS (ORDER BY n, rank)),
a AS (SELECT n, count(*) AS c FROM len GROUP BY 1), b AS (SELECT n, count(*) AS c FROM s GROUP BY 1), df AS (SELECT * FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)))
SELECT (SELECT count(*) FROM df) AS histogram_differs, (SELECT count(*) FILTER (pos <> coalesce(prev, 1)) FROM (SELECT pos, lag(pos + n) OVER (ORDER BY k) AS prev FROM s)) AS gaps"""
SQL["length_index"] = f"WITH {INDEX} SELECT * FROM idx"
SQL["token_offset"] = f"WITH {INDEX}, ask AS (SELECT unnest([1, 700, 1500, 5000, 1000000000])::BIGINT AS asked) SELECT asked, coalesce((SELECT token_offset FROM idx WHERE min_tokens >= asked ORDER BY min_tokens LIMIT 1), (SELECT sum(n_tokens) FROM laid))::BIGINT AS token_offset FROM ask"
SQL["band_docs"] = f"""WITH {INDEX}, bands AS (SELECT * FROM (VALUES ('short', 0, 700), ('middle', 700, 1500), ('long', 1500, 1000000000)) v(band, lo, hi)),
e AS (SELECT band, coalesce((SELECT token_offset FROM idx WHERE min_tokens >= lo ORDER BY min_tokens LIMIT 1), (SELECT sum(n_tokens) FROM laid)) AS t0, coalesce((SELECT token_offset FROM idx WHERE min_tokens >= hi ORDER BY min_tokens LIMIT 1), (SELECT sum(n_tokens) FROM laid)) AS t1 FROM bands),
s AS (SELECT band, (SELECT [doc_offset, token_offset] FROM idx ORDER BY abs(token_offset - t0), min_tokens LIMIT 1) AS a, (SELECT [doc_offset, token_offset] FROM idx ORDER BY abs(token_offset - t1), min_tokens LIMIT 1) AS b FROM e)
SELECT band, b[1] - a[1] AS n_docs, round((b[2] - a[2]) / nullif(b[1] - a[1], 0), 6) AS mean_tokens FROM s"""
SQL["window_cut"] = f"WITH {WINDOW} SELECT win AS \"window\", md5(string_agg(t::VARCHAR, ',' ORDER BY pos)) AS x_md5, md5(string_agg(y::VARCHAR, ',' ORDER BY pos)) AS y_md5 FROM win, top WHERE win < nw GROUP BY 1"
SQL["segment_ids"] = f"WITH {WINDOW} SELECT win AS \"window\", md5(string_agg(g::VARCHAR, ',' ORDER BY pos)) AS seg_md5 FROM win, top WHERE win < nw GROUP BY 1"
SQL["window_stats"] = f"WITH {WINDOW}, w AS (SELECT win, max(g) AS g FROM win, top WHERE win < nw GROUP BY 1) SELECT count(*) AS n_windows, round(avg(g) + 1, 6) AS segs_per_window FROM w"
SQL["attention_pairs"] = f"WITH {WINDOW}, s AS (SELECT win, g, count(*) AS k FROM win, top WHERE win < nw GROUP BY 1, 2) SELECT win AS \"window\", sum(k * (k + 1) // 2)::BIGINT AS pairs FROM s GROUP BY 1"
EPOCH = f"{POOL}, nw AS (SELECT ((sum(n_tokens) - 1) // 512)::BIGINT AS n FROM laid), ep AS (SELECT epoch, w, row_number() OVER (PARTITION BY epoch ORDER BY md5(concat_ws('|', '42', 'epoch', epoch, w)), w) - 1 AS pos FROM (SELECT unnest(range(n)) AS w FROM nw), range(2) e(epoch))"
SQL["epoch_order"] = f"WITH {EPOCH} SELECT epoch, pos, w AS \"window\" FROM ep WHERE epoch > 0 OR pos >= 100"
SQL["shard_slices"] = f"WITH {EPOCH} SELECT pos, w AS \"window\" FROM ep WHERE epoch = 0 AND pos % 8 = 3"
SQL["replacement_sample"] = f"WITH {POOL} SELECT i AS draw, ('0x' || substr(md5(concat_ws('|', '42', 'draw', i)), 1, 8))::BIGINT % (SELECT sum(n_tokens) - 512 FROM laid)::BIGINT AS \"offset\" FROM range(1000) t(i)"
SQL["special_block"] = "SELECT i AS id, CASE i WHEN 0 THEN '<|endoftext|>' WHEN 1 THEN '<|im_start|>' WHEN 2 THEN '<|im_end|>' ELSE '<|reserved_' || (i - 3) || '|>' END AS name, i > 2 AS reserved FROM range(32) t(i)"
SQL["strip_specials"] = f"WITH {DOCS}, t AS (SELECT doc_id, '<|im_<|endoftext|>start|>' || text AS x FROM d) SELECT doc_id, md5({STRIP.format('x')}) AS text_md5 FROM t"
SQL["fold_system"] = f"WITH {CONV} SELECT conv_id, len(turns) AS n_turns, md5(array_to_string([x.role || ':' || x.content FOR x IN turns], '|')) AS turns_md5 FROM f WHERE len(turns) >= 2"
SQL["chat_spans"] = f"WITH {TURN} SELECT conv_id, any_value(1 + 3 * n) AS n_spans, md5('<|endoftext|>' || string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY i)) AS text_md5, (2 * count(*) FILTER (role = 'assistant'))::BIGINT AS n_target FROM u WHERE n >= 2 GROUP BY 1"
SQL["span_concat"] = f"WITH {TURN}, j AS (SELECT conv_id, string_agg(hex(encode('<|im_start|>' || role || chr(10))) || hex(encode(content)) || hex(encode('<|im_end|>' || chr(10))), '' ORDER BY i) AS a, hex(encode(string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY i))) AS b FROM u GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (a <> b) AS differing FROM j"
SQL["render_prompt"] = f"WITH {TURN} SELECT conv_id, md5('<|endoftext|>' || string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY i) || '<|im_start|>assistant' || chr(10)) AS prompt_md5 FROM u GROUP BY 1"
SQL["split_turns"] = f"WITH RECURSIVE {PAIRS} SELECT conv_id, pair, n_tokens::BIGINT AS n_tokens, chunk::BIGINT AS chunk FROM r"
SQL["render_chat"] = f"WITH RECURSIVE {EXAMPLES} SELECT * FROM ex"
SQL["truncate_drop"] = f"WITH RECURSIVE {EXAMPLES} SELECT count(*) FILTER (NOT dropped) AS n_examples, count(*) FILTER (truncated) AS n_truncated, count(*) FILTER (dropped) AS n_dropped, (2048 * count(*) FILTER (dropped))::BIGINT AS n_dropped_tokens, coalesce(sum(n_tokens) FILTER (NOT dropped), 0)::BIGINT AS n_tokens, coalesce(sum(n_target) FILTER (NOT dropped), 0)::BIGINT AS n_target FROM ex"
SQL["ffd_pack"] = f"""WITH RECURSIVE {EXAMPLES}, o AS (SELECT conv_id, chunk, n_tokens, row_number() OVER (ORDER BY n_tokens DESC, md5(concat_ws('|', '42', 'pack', conv_id, chunk)), conv_id, chunk) AS i FROM ex WHERE NOT dropped),
z AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS room, 0::BIGINT AS bin
  UNION ALL SELECT o.i, CASE WHEN b IS NULL THEN list_append(room, 2048 - n_tokens) ELSE list_concat(room[:b - 1], [room[b] - n_tokens], room[b + 1:]) END, coalesce(b, len(room) + 1)
  FROM (SELECT o.i, o.n_tokens, z.room, list_position(list_transform(z.room, lambda x: x >= o.n_tokens), true) AS b FROM z JOIN o ON o.i = z.i + 1) o)
SELECT conv_id, chunk, n_tokens, bin - 1 AS bin FROM o JOIN z USING (i)"""
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NWS = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
CHUNKS = f"{DOCS}, ch AS (SELECT unnest(regexp_extract_all(text, '{WS}*{NWS}+|{WS}+')) AS chunk FROM d), cc AS (SELECT chunk, count(*) AS n FROM ch GROUP BY 1)"
SQL["chunk_freq"] = f"WITH {CHUNKS} SELECT chunk, n FROM cc"
SQL["bpe_pair_counts"] = f"WITH {CHUNKS}, hx AS (SELECT hex(encode(chunk)) AS h, n FROM cc), pr AS (SELECT ('0x' || substr(h, 2 * i + 1, 2))::INT AS \"left\", ('0x' || substr(h, 2 * i + 3, 2))::INT AS \"right\", n FROM (SELECT h, n, unnest(range(length(h) // 2 - 1)) AS i FROM hx)) SELECT \"left\", \"right\", sum(n)::BIGINT AS n FROM pr GROUP BY 1, 2"
SQL["bpe_roundtrip"] = f"WITH {DOCS} SELECT doc_id, md5(text) AS text_md5 FROM d"
SQL["repetition_rate"] = f"""WITH {DOCS}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM d), g AS (SELECT doc_id, list_slice(w, i + 1, i + 20) AS gram FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM w)),
h AS (SELECT doc_id FROM (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY 1, 2) WHERE c >= 3 GROUP BY 1) SELECT round((SELECT count(*) FROM h) / greatest(1, count(*)), 6) AS rate, count(*) AS n FROM d"""
MC = "mc AS (SELECT item_id, question, choices.text AS options, list_position(choices.label, answer_key)::BIGINT - 1 AS answer FROM eval_items WHERE list_contains(choices.label, answer_key) ORDER BY item_id LIMIT 200)"
SQL["mc_items"] = f"WITH {MC} SELECT * FROM mc"
SQL["mc_accuracy"] = f"WITH {MC}, o AS (SELECT item_id, answer, options, unnest(range(len(options))) AS o FROM mc), k AS (SELECT item_id, answer, o, unnest(range(1, octet_length(encode(options[o + 1])) + 1)) AS at_ FROM o), s AS (SELECT item_id, answer, o, avg(-('0x' || substr(md5(concat_ws('|', item_id, o, at_)), 1, 6))::BIGINT) AS l FROM k GROUP BY 1, 2, 3), b AS (SELECT item_id, answer, o FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY l DESC, o) = 1) SELECT count(*) AS n, round(count(*) FILTER (o = answer) / greatest(1, count(*)), 6) AS accuracy FROM b"
SQL["top_p_filter"] = """WITH n AS (SELECT dataset_name AS row_id, lang AS token, count(*) AS n FROM documents WHERE lang IS NOT NULL AND dataset_name IS NOT NULL GROUP BY 1, 2), p AS (SELECT row_id, token, n / sum(n) OVER (PARTITION BY row_id) AS p FROM n),
k AS (SELECT row_id, token, p, sum(p) OVER (PARTITION BY row_id ORDER BY p DESC, token ROWS UNBOUNDED PRECEDING) - p AS b FROM p) SELECT row_id, token, round(p / sum(p) OVER (PARTITION BY row_id), 6) AS p FROM k WHERE b < 0.9"""
SQL["decode_batches"] = f"""WITH {TURN}, pr AS (SELECT conv_id, octet_length(encode('<|endoftext|>' || string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY i) || '<|im_start|>assistant' || chr(10)))::BIGINT AS n_tokens FROM u GROUP BY 1),
s AS (SELECT n_tokens, count(*) AS n, greatest(1, 64000000 // ((n_tokens + 256) * 32000)) AS rows_ FROM pr GROUP BY 1) SELECT n_tokens, batch, least(rows_, n - batch * rows_)::BIGINT AS n_prompts FROM (SELECT *, unnest(range((n - 1) // rows_ + 1)) AS batch FROM s)"""
SQL["fit_history"] = """WITH c AS (SELECT conv_id, messages FROM conversations WHERE messages IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY received_at) = 1),
k AS (SELECT conv_id, [octet_length(encode(coalesce(x.content, ''))) + octet_length(encode(x.role)) + 4 FOR x IN messages IF x.role IN ('user', 'assistant')] AS cost FROM c),
s AS (SELECT conv_id, len(cost) AS n, unnest(range(0, len(cost) + 2, 2)) AS s0, cost FROM k), v AS (SELECT conv_id, n, least(s0, n) AS s, coalesce(list_sum(cost[least(s0, n) + 1:]), 0) + 12 AS left_ FROM s)
SELECT conv_id, s::BIGINT AS dropped, left_::BIGINT AS n_prompt FROM v WHERE left_ + 256 <= 2048 OR n - s <= 1 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY s) = 1"""
SQL["lr_schedule"] = "SELECT i AS step, round(3e-4 * CASE WHEN i < 100 THEN (i + 1) / 100 WHEN i < 800 THEN 1.0 ELSE greatest(0.0, (1000 - i) / 200) END, 10) AS lr, round(3e-4 * 0.5 * (1 + cos(pi() * i / 1000)), 10) AS cosine FROM range(1000) t(i)"
SQL["token_budget"] = f"WITH {RUNS} SELECT run_id, (65536 * world_size)::BIGINT AS tokens_per_update, greatest(1, round_even(tokens_seen / (65536 * world_size), 0))::BIGINT AS steps FROM h WHERE world_size IS NOT NULL AND tokens_seen IS NOT NULL"
SQL["run_history"] = f"WITH {RUNS} SELECT run_id, corpus.name AS corpus_name, row_number() OVER w AS pos, sum(tokens_seen) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS tokens_so_far, round(val_loss * tokens_per_byte / ln(2), 6) AS bpb FROM h WINDOW w AS (PARTITION BY corpus.name ORDER BY started_at NULLS FIRST, run_id)"
SQL["corpus_hash"] = "SELECT spec_name, substr(sha256(concat_ws('|', kind, sep, pack, coalesce(pack_block::VARCHAR, 'none'), CASE WHEN kind = 'chat' THEN concat_ws(',', messages_column, coalesce(max_example_tokens::VARCHAR, 'none')) ELSE text_column END)), 1, 8) AS hash FROM render_specs"
SQL["prune_orphans"] = f"WITH {DOCS}, live AS (SELECT DISTINCT unnest(shards) AS shard FROM source_parts) SELECT shard, count(*) AS n_rows, sum(nb)::BIGINT AS n_bytes FROM d WHERE shard IS NOT NULL AND shard NOT IN (SELECT shard FROM live WHERE shard IS NOT NULL) GROUP BY 1"
SQL["band_order"] = f"""WITH {INDEX}, tot AS (SELECT sum(n_tokens) AS n FROM laid), ask AS (SELECT coalesce((SELECT token_offset FROM idx WHERE min_tokens >= 700 ORDER BY min_tokens LIMIT 1), (SELECT n FROM tot)) AS b0, coalesce((SELECT token_offset FROM idx WHERE min_tokens >= 1500 ORDER BY min_tokens LIMIT 1), (SELECT n FROM tot)) AS b1),
z0 AS (SELECT ((n - 1) // 512)::BIGINT AS n, least((n - 1) // 512, ceil(b0 / 512))::BIGINT AS lo, least((n - 1) // 512, b1 // 512)::BIGINT AS hi FROM tot, ask),
z AS (SELECT n, lo, hi, floor((n - (hi - lo)) / 0.75)::BIGINT AS n_out, floor(floor((n - (hi - lo)) / 0.75) * 0.25)::BIGINT AS n_band FROM z0),
p AS (SELECT pos, least(n_band, floor(pos * 0.25)::BIGINT) AS b, least(n_band, floor((pos + 1) * 0.25)::BIGINT) AS u FROM (SELECT unnest(range(n_out)) AS pos, n_band FROM z)),
s AS (SELECT pos, u > b AS in_band, CASE WHEN u > b THEN b ELSE pos - b END AS k FROM p),
w AS (SELECT win, win >= lo AND win < hi AS in_band FROM (SELECT unnest(range(n)) AS win, lo, hi FROM z)),
c AS (SELECT in_band, count(*) AS size FROM w GROUP BY 1),
r AS (SELECT in_band, rep * size + row_number() OVER (PARTITION BY in_band, rep ORDER BY md5(concat_ws('|', '42', 'band', in_band, rep, win)), win) - 1 AS k, win FROM w JOIN c USING (in_band), range(400) t(rep) WHERE rep <= (SELECT n_out FROM z) // size)
SELECT pos, in_band, win AS "window" FROM s JOIN r USING (in_band, k)"""
SQL["bpe_merge_step"] = f"""WITH {CHUNKS}, hx AS (SELECT chunk, hex(encode(chunk)) AS h, n FROM cc), pr AS (SELECT substr(h, 2 * i + 1, 2) AS a, substr(h, 2 * i + 3, 2) AS b, n FROM (SELECT h, n, unnest(range(length(h) // 2 - 1)) AS i FROM hx)),
best AS (SELECT 'x' || a || 'x' || b AS pair FROM (SELECT a, b, sum(n) AS n FROM pr GROUP BY 1, 2) ORDER BY n DESC, a, b LIMIT 1)
SELECT chunk, replace(regexp_replace(h, '(..)', 'x\\1', 'g'), (SELECT pair FROM best), 'z') AS merged FROM hx"""
SQL["stream_parts"] = "SELECT part_split, count(*) AS n_conversations, sum(coalesce(len(messages), 0))::BIGINT AS n_messages FROM (SELECT DISTINCT ON (conv_id) part_split, messages FROM conversations) GROUP BY 1"
SQL["stream_weeks"] = "SELECT (epoch(loaded_at)::BIGINT // 604800) * 604800 AS week, count(*) AS n_docs, coalesce(sum(octet_length(encode(text))), 0)::BIGINT AS n_bytes FROM documents WHERE loaded_at IS NOT NULL GROUP BY 1"
SQL["window_masked"] = f"""WITH RECURSIVE {EXAMPLES}, lay AS (SELECT conv_id, chunk, n_tokens, coalesce(sum(n_tokens) OVER (ORDER BY md5(concat_ws('|', '42', 'chat', conv_id, chunk)), conv_id, chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM ex WHERE NOT dropped),
sp AS (SELECT conv_id, chunk, a + ta AS b, least(a + n_first, 2048) AS e FROM ats WHERE ta IS NOT NULL UNION ALL SELECT conv_id, chunk, a + n_first + tb, least(a + n_tokens, 2048) FROM ats WHERE tb IS NOT NULL),
pos AS (SELECT off + unnest(range(b::BIGINT, e::BIGINT)) AS p FROM sp JOIN lay USING (conv_id, chunk) WHERE b < e),
hd AS (SELECT off // 512 AS w, min(off) AS head FROM lay GROUP BY 1),
cnt AS (SELECT (p - 1) // 512 AS w, count(*) AS n_target, count(*) FILTER (p >= head + 1) AS n_kept FROM pos LEFT JOIN hd ON hd.w = (p - 1) // 512 WHERE p >= 1 GROUP BY 1)
SELECT w0.w AS "window", coalesce(n_target, 0)::BIGINT AS n_target, coalesce(n_kept, 0)::BIGINT AS n_kept FROM (SELECT unnest(range((sum(n_tokens)::BIGINT - 1) // 512)) AS w FROM lay) w0 LEFT JOIN cnt USING (w)"""
FFD = f"""{EXAMPLES}, o AS (SELECT conv_id, chunk, n_tokens, row_number() OVER (ORDER BY n_tokens DESC, md5(concat_ws('|', '42', 'pack', conv_id, chunk)), conv_id, chunk) AS i FROM ex WHERE NOT dropped),
z AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS room, 0::BIGINT AS bin
  UNION ALL SELECT o.i, CASE WHEN b IS NULL THEN list_append(room, 2048 - n_tokens) ELSE list_concat(room[:b - 1], [room[b] - n_tokens], room[b + 1:]) END, coalesce(b, len(room) + 1)
  FROM (SELECT o.i, o.n_tokens, z.room, list_position(list_transform(z.room, lambda x: x >= o.n_tokens), true) AS b FROM z JOIN o ON o.i = z.i + 1) o)"""
HEXIDS = "list_transform(range(len({0}) // 2), lambda q: list_extract([" + ", ".join(str(x) for x in (*range(220, 253), *range(32, 126), *range(253, 287), *range(126, 138), 287, *range(138, 220))) + "], ('0x' || substr({0}, (2 * q + 1)::INT, 2))::INT + 1))"
ARRAYS = """, tk AS (SELECT conv_id, i, role, [1] || IDS1 || [230] AS hd, IDS2 || [2, 230] AS bd FROM (SELECT conv_id, i, role, hex(encode(role)) AS hr, hex(encode(content)) AS hc FROM u WHERE n >= 2)),
ar AS (SELECT tk.conv_id, r.chunk::BIGINT AS chunk, ([0] || flatten(list(hd || bd ORDER BY i)))[1:2048] AS ids, ([0] || flatten(list(list_transform(hd, lambda y: 0) || list_transform(bd, lambda y: CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) ORDER BY i)))[1:2048] AS tg FROM tk JOIN r ON r.conv_id = tk.conv_id AND r.pair = tk.i // 2 GROUP BY 1, 2),
ax AS (SELECT ar.*, ex.n_tokens, ex.truncated FROM ar JOIN ex USING (conv_id, chunk) WHERE NOT dropped)""".replace("IDS1", HEXIDS.format("hr")).replace("IDS2", HEXIDS.format("hc"))
SQL["chat_meta"] = f"""WITH RECURSIVE {FFD}, cn AS (SELECT count(*) FILTER (NOT dropped) AS n_examples, count(*) FILTER (dropped) AS n_dropped, (2048 * count(*) FILTER (dropped))::BIGINT AS n_dropped_tokens, count(*) FILTER (truncated) AS n_truncated, coalesce(sum(n_tokens) FILTER (NOT dropped), 0)::BIGINT AS n_real_tokens, coalesce(sum(n_target) FILTER (NOT dropped), 0)::BIGINT AS nt FROM ex),
w AS (SELECT (max(bin) * 2048 + 1)::BIGINT AS n_tokens FROM z), b AS (SELECT coalesce(sum(octet_length(encode(x.content))), 0)::BIGINT AS n_bytes FROM (SELECT unnest(turns) AS x FROM f WHERE len(turns) >= 2))
SELECT n_tokens, n_real_tokens, n_tokens - n_real_tokens AS n_pad_tokens, n_bytes, round(n_real_tokens / n_bytes, 6) AS tokens_per_byte, n_examples, n_dropped, n_dropped_tokens, n_truncated, round(nt / n_tokens, 6) AS target_frac, true AS has_target, true AS has_start, 'bfd' AS pack, 2048::BIGINT AS pack_block FROM cn, w, b"""
SQL["chat_arrays"] = f"WITH RECURSIVE {EXAMPLES}{ARRAYS} SELECT conv_id, chunk, len(ids)::BIGINT AS n, md5(array_to_string(ids, ',')) AS ids_md5, md5(array_to_string(tg, ',')) AS target_md5, truncated FROM ax"
SQL["packed_stream"] = f"""WITH RECURSIVE {FFD}{ARRAYS}, pb AS (SELECT bin - 1 AS bin, flatten(list(ids ORDER BY i)) AS ids, flatten(list(tg ORDER BY i)) AS tg, flatten(list([1] || list_transform(range(len(ids) - 1), lambda y: 0) ORDER BY i)) AS st FROM ax JOIN o USING (conv_id, chunk) JOIN z USING (i) GROUP BY 1),
pd AS (SELECT bin, ids, tg, st, range(2048 - len(ids)) AS p FROM pb UNION ALL SELECT max(bin) + 1, [3], [0], [1], [] FROM pb)
SELECT bin::BIGINT AS bin, md5(array_to_string(ids || list_transform(p, lambda y: 3), ',')) AS ids_md5, md5(array_to_string(tg || list_transform(p, lambda y: 0), ',')) AS target_md5, md5(array_to_string(st || list_transform(p, lambda y: CASE WHEN y = 0 THEN 1 ELSE 0 END), ',')) AS start_md5 FROM pd"""
SQL["window_targets"] = f"""WITH RECURSIVE {EXAMPLES}{ARRAYS}, lay AS (SELECT ids, tg, coalesce(sum(len(ids)) OVER (ORDER BY md5(concat_ws('|', '42', 'chat', conv_id, chunk)), conv_id, chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM ax),
fl AS (SELECT off + k AS pos, ids[k + 1] AS t, tg[k + 1] AS g, k = 0 AS s FROM (SELECT off, ids, tg, unnest(range(len(ids))) AS k FROM lay)),
wn AS (SELECT pos // 512 AS win, pos, t, s, lead(t) OVER (ORDER BY pos) AS y, lead(g) OVER (ORDER BY pos) AS yg, min(CASE WHEN s THEN pos END) OVER (PARTITION BY pos // 512) AS head, sum(s::INT) OVER (PARTITION BY pos // 512 ORDER BY pos) AS seg FROM fl), tp AS (SELECT max(pos) // 512 AS nw FROM fl)
SELECT win AS "window", md5(string_agg(t::VARCHAR, ',' ORDER BY pos)) AS x_md5, md5(string_agg((CASE WHEN yg = 1 AND pos >= head THEN y ELSE -100 END)::VARCHAR, ',' ORDER BY pos)) AS y_md5, md5(string_agg(seg::VARCHAR, ',' ORDER BY pos)) AS seg_md5 FROM wn, tp WHERE win < nw GROUP BY 1"""
SQL["loss_share"] = SQL["window_targets"].split("SELECT win AS ")[0] + "SELECT count(DISTINCT win) AS n_windows, round(count(*) FILTER (yg = 1 AND pos >= head) / count(*), 6) AS frac_loss_tokens FROM wn, tp WHERE win < nw"
SQL["batch_merge"] = """WITH b AS (SELECT * FROM rendered_batches QUALIFY row_number() OVER (PARTITION BY batch_id, worker ORDER BY received_at NULLS LAST, finished_at NULLS LAST) = 1)
SELECT count(*) AS n_batches, coalesce(sum(n_examples), 0)::BIGINT AS n_examples, coalesce(sum(n_dropped), 0)::BIGINT AS n_dropped, coalesce(sum(n_dropped_tokens), 0)::BIGINT AS n_dropped_tokens, coalesce(sum(n_bytes), 0)::BIGINT AS n_bytes, coalesce(sum(n_pad), 0)::BIGINT AS n_pad, coalesce(sum(n_truncated), 0)::BIGINT AS n_truncated
FROM b WHERE coalesce(n_examples, 0) > 0 OR coalesce(n_dropped, 0) > 0"""
SQL["stored_scan"] = f"WITH {TOKENS}, m AS (SELECT doc_id, md5(string_agg(t::VARCHAR, ',' ORDER BY pos)) AS ids_md5 FROM tok GROUP BY 1) SELECT doc_id, rank, off::BIGINT AS tok_offset, ids_md5 FROM laid JOIN m USING (doc_id)"
SQL["stored_sort"] = f"WITH {LEN} SELECT doc_id, n, row_number() OVER w - 1 AS new_rank, (1 + coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS new_start, n_tokens::BIGINT AS n_ids FROM len JOIN (SELECT doc_id, n_tokens FROM laid) USING (doc_id) WINDOW w AS (ORDER BY n, rank)"
SQL["corpus_names"] = f"WITH h AS ({SQL['corpus_hash']}) SELECT spec_name, part, concat_ws('-', spec_name, part, hash) AS name FROM h, (VALUES ('train'), ('val')) v(part)"
SQL["preset_lookup"] = "SELECT s.spec_name, s.dataset_name, s.seed, array_to_string(s.column_list, ',') AS columns, (SELECT count(*) FROM source_parts p WHERE p.spec_name = s.spec_name) AS n_parts FROM source_specs s"
SQL["window_seeds"] = "SELECT spec_name, seed AS train_seed, seed + 10000 AS val_seed FROM source_specs"
SQL["val_order"] = f"WITH {EPOCH.replace(chr(39) + '42' + chr(39) + ', ' + chr(39) + 'epoch', chr(39) + '10042' + chr(39) + ', ' + chr(39) + 'epoch')} SELECT pos, w AS \"window\" FROM ep WHERE epoch = 0"
SQL["window_batches"] = f"WITH {EPOCH} SELECT pos // 16 AS batch, string_agg(w::VARCHAR, ',' ORDER BY pos) AS windows FROM ep WHERE epoch = 0 GROUP BY 1"
SQL["epoch_steps"] = f"WITH {DOCS}, t AS (SELECT sum(nb + 3)::BIGINT AS n FROM d) SELECT e AS epochs, greatest(1, round_even(n * e / 8192, 0))::BIGINT AS steps, greatest(1, ((n - 1) // 512) // 16)::BIGINT AS clean_pass FROM t, range(1, 4) r(e)"
SQL["expected_segments"] = f"WITH bd AS ({SQL['band_docs']}) SELECT round(sum(CASE WHEN band = 'middle' THEN 0.25 ELSE 0.75 END * (512 / greatest(1.0, coalesce(mean_tokens, 1.0)) + 1)), 4) AS expected FROM bd WHERE band IN ('short', 'middle')"
SQL["human_counts"] = "SELECT DISTINCT batch_id, n_bytes, CASE WHEN coalesce(n_bytes, 0) = 0 THEN '-' WHEN n_bytes >= 1e9 THEN printf('%.2fB', n_bytes / 1e9) WHEN n_bytes >= 1e6 THEN printf('%.2fM', n_bytes / 1e6) WHEN n_bytes >= 1e3 THEN printf('%.2fK', n_bytes / 1e3) ELSE n_bytes::VARCHAR END AS shown FROM rendered_batches"
SQL["mc_answer_start"] = """WITH o AS (SELECT item_id, question, octet_length(encode(question)) AS q, choices.text AS c, unnest(range(len(choices.text))) AS option FROM eval_items),
n AS (SELECT item_id, option, greatest(0, q - greatest(0, octet_length(encode(concat_ws(' ', question, c[option + 1]))) - 256))::BIGINT AS n_ctx FROM o) SELECT item_id, option, n_ctx, greatest(0, n_ctx - 1)::BIGINT AS first FROM n"""
SQL["format_compliance"] = f"""WITH c AS (SELECT conv_id, messages FROM conversations WHERE messages IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY received_at) = 1),
d AS (SELECT conv_id AS doc_id, [x.content FOR x IN messages IF x.role = 'assistant' AND x.content IS NOT NULL][-1] AS text FROM c WHERE len([x.content FOR x IN messages IF x.role = 'assistant' AND x.content IS NOT NULL]) > 0),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM d), g AS (SELECT doc_id, list_slice(w, i + 1, i + 20) AS gram FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM w)),
h AS (SELECT doc_id FROM (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY 1, 2) WHERE c >= 3 GROUP BY 1), s AS (SELECT text, octet_length(encode(text)) AS k FROM d)
SELECT count(*) AS n, round(count(*) FILTER (k < 256) / count(*), 6) AS stopped, round(count(*) FILTER (k >= 256) / count(*), 6) AS hit_cap, round(sum(least(k, 256)) / count(*), 6) AS mean_len, round(count(*) FILTER (contains(text, '<|im_start|>')) / count(*), 6) AS stray_role, round(count(*) FILTER (contains(text, '<|endoftext|>')) / count(*), 6) AS relapsed_to_eot, round((SELECT count(*) FROM h) / count(*), 6) AS repetition FROM s"""
SQL["tokenizer_ids"] = f"SELECT 288::BIGINT AS n_vocab, 0::BIGINT AS sep_id, 2::BIGINT AS end_id, {FINGER} AS fingerprint"
SQL["shard_scan"] = "SELECT doc_id, lang FROM documents"
SQL["shard_concat"] = f"WITH {POOL} SELECT doc_id, rank % 8 AS shard, row_number() OVER (ORDER BY rank % 8, rank) - 1 AS pos FROM laid"
SQL["notebook_split"] = f"WITH {POOL} SELECT doc_id, CASE WHEN rank < 10000 THEN 'train' ELSE 'held_out' END AS part FROM laid WHERE rank < 10200"
