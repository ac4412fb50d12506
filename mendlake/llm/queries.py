"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendlake.llm import crosspolytope, decontaminate, forest, lexical, licenses, mixing, personal_data, secret_scan, sharding, toolcalls, toxicity, trie, warc
from mendlake.llm.store import materialise
from mendlake.llm.toolcalls import Param
from mendlake.tables import table

#: Words by how common they are, for guess costs; without the file the query fails.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHARDS = [f"shard-{i:02d}" for i in range(16)]
DOMAINS = ["web", "forum", "reference", "books"]
MIX = {
    "domain": {"web": 0.4, "forum": 0.2, "reference": 0.3, "books": 0.1},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    "source": {"src0": 2.0},
}
MIX_FRACTION, MIX_EPOCHS, MIX_SEED = 0.5, 2, 7


def domain_of(source):
    """The domain of a source: by the number in its name, 'web' without one."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '[0-9]+', 0) as int)"), F.lit(0))
    return F.get(F.array(*map(F.lit, DOMAINS)), F.pmod(number, F.lit(len(DOMAINS))))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.choose(docs, MIX, MIX_FRACTION, MIX_EPOCHS, MIX_SEED, domain_of("source"))


QUERIES = {"op5_sharding": op5_sharding, "op9_mixing": op9_mixing}


def _case(column: str, named: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in sorted(named.items())) + f" ELSE {mixing.OTHER_WEIGHT!r}::DOUBLE END"


def _slots_sql() -> str:
    """Turn by turn: each row of the recursion is the table after one more claim."""
    m, names = sharding.SLOTS, ", ".join(f"'{s}'" for s in SHARDS)
    digits = f"('0x' || substr(md5('%s:' || name), 1, {sharding.HEX}))::BIGINT"
    return f"""
    shards AS (SELECT i - 1 AS shard, ([{names}])[i] AS name FROM range(1, {len(SHARDS) + 1}) r(i)),
    orders AS (SELECT shard, name, {digits % "offset"} % {m} AS start, {digits % "skip"} % {m - 1} + 1 AS step FROM shards),
    all_orders AS (SELECT list(start ORDER BY shard) AS starts, list(step ORDER BY shard) AS steps FROM orders),
    turns AS (
        SELECT 0 AS n, list_transform(range(0, {m}), lambda x: -1) AS owner, list_transform(range(0, {len(SHARDS)}), lambda x: 0::BIGINT) AS next
        UNION ALL
        SELECT n + 1, list_transform(owner, lambda o, i: CASE WHEN i - 1 = slot THEN shard ELSE o END), list_transform(next, lambda o, i: CASE WHEN i - 1 = shard THEN turn + 1 ELSE o END)
        FROM (
            SELECT n, owner, next, shard, turn, (starts[shard + 1] + turn * steps[shard + 1]) % {m} AS slot
            FROM (
                SELECT t.n, t.owner, t.next, (t.n % {len(SHARDS)})::INT AS shard, a.starts, a.steps,
                    list_filter(range(t.next[(t.n % {len(SHARDS)}) + 1], {m}), lambda j: t.owner[(a.starts[(t.n % {len(SHARDS)}) + 1] + j * a.steps[(t.n % {len(SHARDS)}) + 1]) % {m} + 1] = -1)[1] AS turn
                FROM turns t, all_orders a WHERE t.n < {m}
            )
        )
    ),
    filled AS (SELECT unnest(range(0, {m})) AS slot, unnest(owner) AS shard FROM turns WHERE n = {m})"""


def place_sql(docs: str, columns: str) -> str:
    return f"""
    WITH RECURSIVE {_slots_sql()},
    placed AS (SELECT {columns}, (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, {sharding.HEX}))::BIGINT % {sharding.SLOTS})::INT AS slot FROM {docs})
    SELECT {columns}, placed.slot, filled.shard::INT AS shard, shards.name AS shard_name FROM placed JOIN filled USING (slot) JOIN shards USING (shard)
    """


def _fill_sql(rows: str, parent: str, node: str, budget: str, out: str) -> str:
    """Water-filling: the largest level that spends the budget, found among the children's own ratios."""
    return f"""
    SELECT *, CASE WHEN weight <= 0 THEN 0.0 WHEN share IS NULL OR cap / weight <= share THEN cap ELSE greatest(0.0, share * weight) END AS {out}
    FROM (
        SELECT *, min_by(level, (cap / weight, {node})) FILTER (WHERE level < cap / weight) OVER (PARTITION BY {parent}) AS share
        FROM (
            SELECT *, ({budget} - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, {node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM ({rows})
        )
    )"""


def mix_sql(docs: str) -> str:
    """WITH parts that end in chosen(doc_id, domain, lang, source, tokens, epoch, budget)."""
    domains = ", ".join(f"'{d}'" for d in DOMAINS)
    top = 16**mixing.HEX
    rows_domain = f"SELECT domain, domain AS node, sum(tokens) * {float(MIX_EPOCHS)} AS cap, any_value(total) * {MIX_FRACTION!r}::DOUBLE AS root, {_case('domain', MIX['domain'])} AS weight FROM leaves, totals GROUP BY domain"
    rows_lang = f"SELECT l.domain, lang, lang AS node, sum(tokens) * {float(MIX_EPOCHS)} AS cap, any_value(domain_budget) AS domain_budget, {_case('lang', MIX['lang'])} AS weight FROM leaves l JOIN d USING (domain) GROUP BY l.domain, lang"
    rows_source = f"SELECT l.domain, l.lang, source, source AS node, tokens, n_docs, tokens * {float(MIX_EPOCHS)} AS cap, lang_budget, {_case('source', MIX['source'])} AS weight FROM leaves l JOIN g USING (domain, lang)"
    return f"""
    words AS (
        SELECT doc_id, ([{domains}])[coalesce(try_cast(regexp_extract(source, '[0-9]+') AS INT), 0) % {len(DOMAINS)} + 1] AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens
        FROM {docs}
    ),
    leaves AS (SELECT domain, lang, source, sum(tokens)::DOUBLE AS tokens, count(*) AS n_docs FROM words GROUP BY ALL),
    totals AS (SELECT sum(tokens) AS total FROM leaves),
    d AS ({_fill_sql(rows_domain, "root", "node", "root", "domain_budget")}),
    g AS ({_fill_sql(rows_lang, "domain", "node", "domain_budget", "lang_budget")}),
    s AS ({_fill_sql(rows_source, "domain, lang", "node", "lang_budget", "raw")}),
    budgets AS (SELECT domain, lang, source, tokens::BIGINT AS leaf_tokens, floor(raw + 1e-6)::BIGINT AS budget FROM s),
    wants AS (SELECT *, greatest(0, least(leaf_tokens, budget - epoch * leaf_tokens)) AS want FROM budgets, (SELECT unnest(range(0, {MIX_EPOCHS}))::INT AS epoch)),
    ordered AS (
        SELECT w.*, t.epoch, t.budget, t.want, ('0x' || substr(md5('{MIX_SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), 1, {mixing.HEX}))::BIGINT AS h
        FROM words w JOIN wants t USING (domain, lang, source) WHERE want > 0
    ),
    summed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY h, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch) AS all_tokens FROM ordered),
    chosen AS (SELECT doc_id, domain, lang, source, tokens, epoch, budget FROM summed WHERE want = all_tokens OR before < want)"""


ORACLES = {
    "op5_sharding": place_sql("documents", "doc_id"),
    "op9_mixing": f"WITH {mix_sql('documents')} SELECT * FROM chosen",
}


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents"))


def near_sql(docs: str) -> str:
    """WITH parts (of a recursive WITH) that end in near(doc_id, n_shingles, component_id)."""
    return f"""
    near_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
    near_sets AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', chr(10))) WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', chr(10))] ELSE []::VARCHAR[] END) AS s
        FROM near_words
    ),
    near_rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM near_sets),
    near_links AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM near_rows a JOIN near_rows b ON a.g = b.g AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
    ),
    near_reach AS (SELECT doc_id AS node, doc_id AS low FROM {docs} UNION SELECT b, low FROM near_reach JOIN near_links ON a = node),
    near AS (SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(low) FROM near_reach WHERE node = doc_id) AS component_id FROM near_sets)"""


QUERIES["op10_near_dedup"] = op10_near_dedup
ORACLES["op10_near_dedup"] = f"WITH RECURSIVE {near_sql('documents')} SELECT *, doc_id = component_id AS kept FROM near"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES |= {"op1_toxicity": op1_toxicity, "op8_decontamination": op8_decontamination}


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index, payloads=False).drop("url")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"], vocabulary=VOCABULARY)


QUERIES |= {"op2_warc": op2_warc, "op7_secret_scan": op7_secret_scan}

#: Base 32 of the 20 bytes of a SHA-1: 40 hex digits are 160 bits, five a letter.
ORACLES["op2_warc"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
    bits AS (SELECT page_id, hex, html, list_aggregate(list_transform(string_split(hex, ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), 'string_agg', '') AS b FROM p),
    firsts AS (SELECT hex, min(page_id) AS low, count(*) AS n FROM p GROUP BY hex)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
        list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(list_sum(list_transform(range(0, 5), lambda j: CASE WHEN b[i * 5 + j + 1] = '1' THEN 1 << (4 - j) ELSE 0 END)) + 1)::INT]), 'string_agg', '') AS payload_digest,
        CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> low THEN low END AS refers_to
    FROM bits JOIN firsts USING (hex)
"""


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"]).drop("spans")


QUERIES["op3_licenses"] = op3_licenses


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.search(table(spark, sf_dir, "embeddings"))


QUERIES["op6_nearest"] = op6_nearest


TOOLS = {
    "search": [Param("query", "string"), Param("limit", "integer", least=0, most=9)],
    "translate": [Param("query", "string"), Param("lang", "string", required=False), Param("limit", "integer", required=False)],
    "calculate": [Param("query", "integer")],
}
TOOL_NAMES = ["search", "translate", "calculate", "fetch"]


def chat_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made from a chat's turns, as the tables have none.

    An assistant turn of n words makes 1 + n % 3 calls with its whole text as the argument. Each depends on the one
    before; the first on the first call two turns earlier if n is divisible by 3, and on the second of its own turn (a
    cycle) if n is divisible by 97. The next user turn answers the calls but every seventh; user turns whose words
    number a multiple of 31 have a result of their own that nobody asked for. A result is the user turn's whole text.
    """
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    turns = turns.select("conv_id", "turn", "role", F.col("text"), words.alias("w")).withColumn("n", F.size("w"))
    name = lambda t, j: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"), F.lit("-"), j.cast("string"))
    made = turns.filter("role = 'assistant'").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") % 3)))
    said = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("x")))
    said = said.substr(F.lit(6), F.length(said) - 6)
    lang = F.when(F.col("n") % 5 == 0, F.lit(', "lang" : "xx"')).otherwise(F.lit(""))
    arguments = F.concat(F.lit('{ "query": '), said, F.lit(', "limit": '), (F.col("n") % 12 - 1).cast("string"), lang, F.when(F.col("n") % 13 == 0, F.lit("")).otherwise(F.lit("}")))
    before = F.when(F.col("j") > 0, name(F.col("turn"), F.col("j") - 1)).when(F.col("n") % 3 == 0, name(F.col("turn") - 2, F.lit(0)))
    cycle = F.when((F.col("j") == 0) & (F.col("n") % 97 == 0), name(F.col("turn"), F.lit(1)))
    tool = F.get(F.array(*map(F.lit, TOOL_NAMES)), (F.col("n") + F.col("j")) % 4)
    calls = made.select("conv_id", name(F.col("turn"), F.col("j")).alias("call_id"), "turn", tool.alias("name"), arguments.alias("arguments"), F.array_compact(F.array(before, cycle)).alias("depends"), "n", "j")
    user = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("at"), F.col("text").alias("content"), F.col("n").alias("m"))
    answers = calls.filter((F.col("n") + F.col("j")) % 7 != 0).withColumn("at", F.col("turn") + 1).join(user, ["conv_id", "at"]).select("conv_id", "call_id", F.col("at").alias("turn"), "content")
    alone = user.filter("m % 31 = 0").select("conv_id", F.concat(F.lit("none-"), F.col("at").cast("string")).alias("call_id"), F.col("at").alias("turn"), "content")
    return calls.drop("n", "j"), answers.unionByName(alone)


def op4_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link(*chat_calls(table(spark, sf_dir, "conversations")), TOOLS)


QUERIES["op4_toolcalls"] = op4_toolcalls
ORACLES["op4_toolcalls"] = """
    WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM conversations),
    c AS (
        SELECT conv_id, turn, j, len(w) AS n, coalesce(text, '') AS said, 'call-' || conv_id || '-' || turn || '-' || j AS call_id,
            ['search', 'translate', 'calculate', 'fetch'][(len(w) + j) % 4 + 1] AS name
        FROM t, range(0, 3) r(j) WHERE role = 'assistant' AND j <= len(w) % 3
    ),
    e AS (
        SELECT conv_id, call_id, 'call-' || conv_id || '-' || turn || '-' || (j - 1) AS dep FROM c WHERE j > 0
        UNION SELECT conv_id, call_id, 'call-' || conv_id || '-' || (turn - 2) || '-0' FROM c WHERE j = 0 AND n % 3 = 0
        UNION SELECT conv_id, call_id, 'call-' || conv_id || '-' || turn || '-1' FROM c WHERE j = 0 AND n % 97 = 0
    ),
    edges AS (SELECT e.call_id, e.dep FROM e JOIN c ON e.dep = c.call_id AND e.conv_id = c.conv_id),
    above AS (SELECT call_id, dep FROM edges UNION SELECT a.call_id, e.dep FROM above a JOIN edges e ON a.dep = e.call_id),
    bad AS (SELECT call_id FROM above WHERE call_id = dep UNION SELECT a.call_id FROM above a JOIN above b ON a.dep = b.call_id AND b.call_id = b.dep),
    steps AS (
        SELECT call_id, 0 AS level FROM c WHERE call_id NOT IN (SELECT call_id FROM edges)
        UNION SELECT e.call_id, s.level + 1 FROM steps s JOIN edges e ON e.dep = s.call_id WHERE e.call_id NOT IN (SELECT call_id FROM bad)
    ),
    lv AS (SELECT call_id, max(level)::INT AS level FROM steps GROUP BY call_id),
    u AS (SELECT conv_id, turn, text AS content, len(w) AS m FROM t WHERE role = 'user'),
    r AS (SELECT c.conv_id, c.call_id, u.turn, u.content FROM c JOIN u ON u.conv_id = c.conv_id AND u.turn = c.turn + 1 WHERE (c.n + c.j) % 7 <> 0),
    called AS (
        SELECT c.conv_id, c.call_id, c.turn, c.name, r.content, r.call_id IS NOT NULL AS answered, lv.level,
            CASE WHEN n % 13 = 0 THEN to_json('{ "query": ' || to_json(said) || ', "limit": ' || (n % 12 - 1) || CASE WHEN n % 5 = 0 THEN ', "lang" : "xx"' ELSE '' END)
                 ELSE '{' || CASE WHEN n % 5 = 0 THEN '"lang":"xx",' ELSE '' END || '"limit":' || (n % 12 - 1) || ',"query":' || to_json(said) || '}' END AS arguments,
            CASE WHEN n % 13 = 0 THEN 'json'
                 WHEN name = 'fetch' THEN 'tool'
                 WHEN name = 'calculate' THEN CASE WHEN n % 5 = 0 THEN 'unknown:lang,' ELSE '' END || 'unknown:limit,type:query'
                 WHEN name = 'translate' THEN ''
                 ELSE concat_ws(',', CASE WHEN n % 5 = 0 THEN 'unknown:lang' END, CASE WHEN n % 12 - 1 NOT BETWEEN 0 AND 9 THEN 'range:limit' END) END AS errors
        FROM c LEFT JOIN r ON r.call_id = c.call_id LEFT JOIN lv ON lv.call_id = c.call_id
    )
    SELECT conv_id, call_id, turn, name, CASE WHEN answered THEN 'answered' ELSE 'unanswered' END AS status, 1::BIGINT AS n_calls, answered::BIGINT AS n_results, level, errors,
        '{"arguments":' || arguments || CASE WHEN errors <> '' THEN ',"error":"' || errors || '"' ELSE '' END || ',"id":"' || call_id || '","name":"' || name || '"' || CASE WHEN answered THEN ',"result":' || to_json(content) ELSE '' END || '}' AS json
    FROM called
    UNION ALL
    SELECT conv_id, 'none-' || turn, turn, NULL, 'orphan', 0, 1, NULL, NULL, '{"id":"none-' || turn || '","result":' || to_json(content) || '}' FROM u WHERE m % 31 = 0
"""

_ALNUM = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: Every window that can be the first best one ends with a shingle of the item, so those windows are enough.
ORACLES["op8_decontamination"] = f"""
    WITH iw AS (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
    ik AS (SELECT *, len(w) AS size, least(5, len(w)) AS k FROM iw WHERE len(w) > 0),
    ig AS (SELECT item_id, size, k, unnest(list_distinct(list_transform(range(1, size - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS g FROM ik),
    weights AS (SELECT k, g, round(1000 * ln(1 + (SELECT count(DISTINCT item_id) FROM ig) / count(DISTINCT item_id)::DOUBLE))::BIGINT AS weight FROM ig GROUP BY k, g),
    items AS (SELECT *, sum(weight) OVER (PARTITION BY item_id) AS total FROM ig JOIN weights USING (k, g)),
    dw AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
    dg AS (SELECT doc_id, len(w) AS n, k, unnest(range(0, len(w) - k + 1)) AS pos, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM dw, (SELECT DISTINCT k FROM ik) WHERE len(w) >= k),
    hits AS (SELECT doc_id, item_id, pos, g, weight, total, least(n, size) - k + 1 AS m FROM dg JOIN items USING (k, g) WHERE n >= {decontaminate.THRESHOLD} * size),
    starts AS (SELECT DISTINCT doc_id, item_id, total, m, greatest(0, pos - m + 1) AS start FROM hits),
    inside AS (SELECT DISTINCT s.doc_id, s.item_id, s.start, s.total, h.g, h.weight FROM starts s JOIN hits h ON s.doc_id = h.doc_id AND s.item_id = h.item_id AND h.pos BETWEEN s.start AND s.start + s.m - 1),
    shares AS (SELECT doc_id, item_id, start, sum(weight) / any_value(total)::DOUBLE AS similarity FROM inside GROUP BY doc_id, item_id, start)
    SELECT doc_id, item_id, start::INT AS start, similarity FROM shares WHERE similarity >= {decontaminate.THRESHOLD}
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op13_lexical"] = op13_lexical
_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
ORACLES["op13_lexical"] = f"""
    WITH asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
    totals AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
    each AS (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
    held AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM each GROUP BY ALL),
    weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
        FROM held, totals GROUP BY term
    ),
    scores AS (
        SELECT item_id, doc_id,
            sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
        FROM asked JOIN held USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id
    )
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM scores WHERE score > 0 QUALIFY rank <= {lexical.BEST}
"""


#: A conversation begins with the first turns of the one whose id is the next lower multiple of FAMILY, fewer than OPENINGS.
FAMILY, OPENINGS = 100, 6


def rebuilt(paths: DataFrame) -> DataFrame:
    """paths with the first crc32(conv_id) % OPENINGS turns of each taken from its family's first conversation.

    All of its turns if it has fewer, none if there is none.
    """
    n = trie.KEY * (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS).cast("int")
    own = paths.select("conv_id", "path", n.alias("n"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"))
    heads = paths.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.substring("path", 1, trie.KEY * (OPENINGS - 1)).alias("head"))
    none = F.lit(b"")
    path = F.concat(F.substring(F.coalesce("head", none), F.lit(1), F.col("n")), F.substring("path", F.col("n") + 1, F.lit(2**31 - 1)))
    return own.join(heads, "family", "left").select("conv_id", path.alias("path"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = materialise(trie.turn_paths(table(spark, sf_dir, "conversations")), "paths")
    return trie.nodes(rebuilt(paths)).drop("node")


QUERIES["op12_prefix_trie"] = op12_prefix_trie
#: CRC-32 of an id's digits, bit by bit: a byte comes in before its first step.
ORACLES["op12_prefix_trie"] = f"""
    WITH RECURSIVE own AS (
        SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS t
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ),
    bits AS (
        SELECT conv_id, 0 AS j, 4294967295::BIGINT AS c FROM own
        UNION ALL
        SELECT conv_id, j + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END
        FROM (SELECT conv_id, j, CASE WHEN j % 8 = 0 THEN xor(c, ascii((conv_id::VARCHAR)[j // 8 + 1])::BIGINT) ELSE c END AS x FROM bits WHERE j < 8 * len(conv_id::VARCHAR))
    ),
    heads AS (SELECT conv_id, xor(c, 4294967295::BIGINT) % {OPENINGS} AS h FROM bits WHERE j = 8 * len(conv_id::VARCHAR)),
    made AS (
        SELECT o.conv_id, list_concat(coalesce(b.t[1:h], []), o.t[h + 1:]) AS t
        FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {FAMILY}
    ),
    seen AS (
        SELECT conv_id, len(t) AS n, d, md5(to_json(t[1:d])::VARCHAR) AS node, CASE WHEN d > 0 THEN md5(to_json(t[1:d - 1])::VARCHAR) END AS parent,
            CASE WHEN d > 0 THEN length(t[d].text) ELSE 0 END AS chars
        FROM made, LATERAL (SELECT unnest(range(0, len(t) + 1)) AS d)
    ),
    nodes AS (
        SELECT node, any_value(parent) AS parent, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
        FROM seen GROUP BY node, d
    ),
    children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
    every AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)),
    above AS (SELECT DISTINCT a.node AS top, b.node FROM seen a JOIN seen b USING (conv_id) WHERE a.d <= b.d),
    sums AS (SELECT top AS node, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM above JOIN every USING (node) GROUP BY top)
    SELECT e.conv_id, e.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, n_leaves, saved_tokens, e.ends_sha256
    FROM every e JOIN sums USING (node) LEFT JOIN nodes p ON p.node = e.parent
"""


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.detect(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES["op11_personal_data"] = op11_personal_data
