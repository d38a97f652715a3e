"""The registered queries of this package, one per operator, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import exact_dedup, lengths, licenses, line_dedup, mixing, ngram_join, packing, pii, quality, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(_table(spark, sf_dir, "documents"))


#: Target weights of the corpus's sources; whatever else turns up shares OTHER_WEIGHT.
SOURCE_WEIGHTS = {f"src{k}": float(4 + 3 * k % 7) for k in range(20)}
OTHER_WEIGHT, MIX_SEED = 4.0, 17


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, OTHER_WEIGHT, seed=MIX_SEED)


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "posterior", "kept")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file lies; it is read there and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op9_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.context_totals(lengths.histogram(_table(spark, sf_dir, "documents"), tokenizer_path()))


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last number of a url's path is the doc_id of the text on the page, whose quality label says if the page is bad."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    number = F.regexp_extract(url_filters.path_of(F.col("url")), "([0-9]{1,18})[^0-9/]*/?$", 1)
    numbered = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id IS NOT NULL")
    return url_filters.judge(pages, URL_RULES, numbered.join(labels, "doc_id").select("url", "bad"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def base_of(query, *names: str):
    """The columns of a query that plain rules define, which SQL can express beside the method's own."""
    return lambda spark, sf_dir: query(spark, sf_dir).select(*names)


def url_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = op8_url_filters(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


QUERIES = {
    "op1_poisson_mix": op1_poisson_mix,
    "op2_pii_boosting": op2_pii_boosting,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_cutting_stock": op6_cutting_stock,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_url_filters": op8_url_filters,
    "op9_token_lengths": op9_token_lengths,
    "op10_license_scan": op10_license_scan,
    "base_of_op2": base_of(op2_pii_boosting, "doc_id", *[f"n_{k}" for k in pii.BASE_KINDS], "base_sha256"),
    "base_of_op4": base_of(op4_quality_rules, "doc_id", *quality.BASE, "base_failed"),
    "base_of_op8": url_base,
    "base_of_op10": base_of(op10_license_scan, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
}

_WEIGHT_ROWS = ", ".join(f"('{k}', {v})" for k, v in SOURCE_WEIGHTS.items())

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DIGITS = "regexp_replace(s.m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN j % 2 = 1 THEN d ELSE d * 2 - CASE WHEN d > 4 THEN 9 ELSE 0 END END FOR d, j IN [x::INT FOR x IN string_split(reverse({_DIGITS}), '')]]) % 10 = 0"
#: Kind, pattern, and what a match s.m has to pass.
_PRIVATE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and([coalesce(TRY_CAST(x AS HUGEINT), 999) <= 255 FOR x IN string_split(s.m, '.')])"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
]


def _private_sql() -> str:
    size = lambda part: f"coalesce(list_sum([length(x) FOR x IN {part}]), 0)::BIGINT"
    found, good = [], []
    for kind, pattern, passes in _PRIVATE:
        found.append(f"regexp_extract_all(t, '{pattern}') AS m_{kind}, regexp_split_to_array(t, '{pattern}') AS p_{kind}")
        spans = f"[{{'a': {size(f'p_{kind}[1:i]')} + {size(f'm_{kind}[1:i - 1]')}, 'm': m_{kind}[i]}} FOR i IN range(1, len(m_{kind}) + 1)]"
        good.append(f"[s FOR s IN {spans} IF {passes}] AS {kind}")
    counts = ", ".join(f"len({k})::BIGINT AS n_{k}" for k, _, _ in _PRIVATE)
    names = " || ".join(f"['{k}:' || s.a || ':' || (s.a + length(s.m)) FOR s IN {k}]" for k, _, _ in _PRIVATE)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {', '.join(found)} FROM d),
        g AS (SELECT doc_id, {', '.join(good)} FROM f)
        SELECT doc_id, {counts}, sha256(array_to_string({names}, ',')) AS base_sha256 FROM g
    """


def _rule_sql() -> str:
    fits = lambda rule: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*rule.split("/", 1))
    ordered = sorted(URL_RULES, key=lambda x: -len(x[1]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[k]}'" for r in ordered) + " END"
    return f"{case(1)} AS rule, {case(0)} AS rule_verdict"


def _phrase_sql() -> str:
    stands = lambda p: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
    places = ", ".join(f"[i - 1 FOR i IN range(1, len(w) + 1) IF {stands(p)}] AS p{k}" for k, p in enumerate(licenses.PHRASES))
    every = " || ".join(f"p{k}" for k in range(len(licenses.PHRASES)))
    labels = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{v}' END" for k, v in enumerate(licenses.PHRASES.values()))
    return f"""
        WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), p AS (SELECT doc_id, len(w)::BIGINT AS n_words, {places} FROM w)
        SELECT doc_id, n_words, len({every})::BIGINT AS n_base, list_min({every})::BIGINT AS first_word, list_max({every})::BIGINT AS last_word,
               array_to_string(list_sort([x FOR x IN [{labels}] IF x IS NOT NULL]), ',') AS base_labels
        FROM p
    """


ORACLE_SQL = {
    "base_of_op2": _private_sql(),
    "base_of_op4": r"""
        WITH w AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
            FROM documents
        ), e AS (
            SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)
        ), r AS (
            SELECT doc_id, i FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
        ), c AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
        ), q AS (
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                   coalesce(n, 0)::BIGINT AS n_repeat_words
            FROM w LEFT JOIN c USING (doc_id)
        )
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q
    """,
    "base_of_op8": f"""
        WITH u AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        )
        SELECT *, {_rule_sql()} FROM u
    """,
    "base_of_op10": _phrase_sql(),
    "op1_poisson_mix": f"""
        WITH w(g, weight) AS (VALUES {_WEIGHT_ROWS}, ('other', {OTHER_WEIGHT})),
        d AS (SELECT *, CASE WHEN source IN (SELECT g FROM w WHERE g <> 'other') THEN source ELSE 'other' END AS g FROM documents),
        s AS (SELECT g, sum(length(coalesce(text, '')))::DOUBLE AS size FROM d GROUP BY g),
        r AS (SELECT g, weight / sum(weight) OVER () * (sum(size) OVER ()) / size AS rate FROM s JOIN w USING (g) WHERE size > 0),
        c AS (SELECT g, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k) AS step
              FROM r, (SELECT unnest(range(0, 200)) AS k)),
        u AS (SELECT *, ('0x' || substr(md5('{MIX_SEED}:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM d),
        n AS (SELECT doc_id, text, lang, source, n_chars, (SELECT count(*) FROM c WHERE c.g = u.g AND c.step <= u.u)::INT AS copies FROM u),
        e AS (SELECT *, unnest(range(0, copies))::INT AS copy FROM n WHERE copies > 0)
        SELECT *, ('0x' || substr(md5('{MIX_SEED}:' || doc_id || ':copy:' || copy), 1, 15))::BIGINT AS shuffle_key FROM e
    """,
    "op3_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
            FROM documents
        ), keyed AS (
            SELECT doc_id, line, k,
                   translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ), repeated AS (
            SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(r.key) AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN r.key IS NULL THEN line END, chr(10) ORDER BY k), '')) AS kept_sha256
        FROM keyed LEFT JOIN repeated r USING (key)
        GROUP BY doc_id
    """,
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
    "op7_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                           ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
            FROM w
        ), e AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS m, any_value(b.n) AS n
            FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS (
            SELECT a, b FROM p WHERE 100 * shared >= 80 * (m + n - shared)
        ), x AS (
            SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), r AS (
            SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, x.b FROM r JOIN x ON r.c = x.a
        )
        SELECT doc_id, len(s) AS n_shingles, c AS component_id
        FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) USING (doc_id)
    """,
}
