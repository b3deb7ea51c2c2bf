"""The same results in plain SQL, for the checks that compare both engines.

Written independently of the operators: dense where they are sparse, windows where they aggregate, and
digamma from its plain eight-step recurrence.
"""

from __future__ import annotations

import numpy as np

from topicloom.registry.inputs import ALPHA, BETA, COVARIANCE, K, MEAN, STICKS, WEIGHTS

KS = range(K)

CORPUS = r"""
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents),
pairs AS (SELECT doc_id, term, count(*) AS cnt FROM words GROUP BY doc_id, term),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, n
          FROM (SELECT term, count(*) AS n FROM pairs GROUP BY term)),
tok AS (SELECT doc_id, term_id, cnt FROM pairs JOIN vocab USING (term)),
docs AS (SELECT doc_id, coalesce(num_words, 0) AS num_words, coalesce(num_unique, 0) AS num_unique
         FROM documents LEFT JOIN (SELECT doc_id, sum(cnt)::BIGINT AS num_words, count(*) AS num_unique
                                   FROM tok GROUP BY doc_id) USING (doc_id))"""


def psi(x: str) -> str:
    z = f"(({x}) + 8.0)"
    steps = " + ".join(f"1.0::DOUBLE / (({x}) + {i})" for i in range(8))
    return (
        f"(ln({z}) - 0.5::DOUBLE / {z} - 1.0::DOUBLE / (12 * {z} ^ 2) + 1.0::DOUBLE / (120 * {z} ^ 4)"
        f" - 1.0::DOUBLE / (252 * {z} ^ 6) + 1.0::DOUBLE / (240 * {z} ^ 8) - 1.0::DOUBLE / (132 * {z} ^ 10)"
        f" - ({steps}))"
    )


def r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0::DOUBLE)"


def each(text: str, sep: str = ", ") -> str:
    """``text`` once per topic, with {k} filled in."""
    return sep.join(text.replace("{k}", str(k)) for k in KS)


def num(x: float) -> str:
    return f"({float(x)!r}::DOUBLE)"


def nums(text: str, values, sep: str = " + ") -> str:
    """``text`` once per topic, with {k} and {v} filled in."""
    return sep.join(text.replace("{k}", str(k)).replace("{v}", num(v)) for k, v in enumerate(values))


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select


TOPIC_STATE = f"""
topic AS (SELECT DISTINCT term_id, {each('(1 + (term_id * 7 + 3 * {k}) % 5)::DOUBLE AS g{k}')} FROM tok),
tots AS (SELECT {each('sum(g{k}) AS t{k}')} FROM topic),
tpsi AS MATERIALIZED (SELECT {each(psi('t{k}') + ' AS p{k}')} FROM tots),
tlog AS (SELECT term_id, {each(psi('g{k}') + ' - p{k} AS l{k}')} FROM topic, tpsi)"""

DOC_STATE = f"""
doc AS (SELECT doc_id, num_words,
    {each('((doc_id + 2 * {k}) % 5)::DOUBLE AS n{k}')},
    {each('(1 + (doc_id + {k}) % 4)::DOUBLE AS a{k}')},
    {each('1.5::DOUBLE + ((doc_id + {k}) % 3) / 2.0::DOUBLE AS b{k}')},
    {each('ln(1 + (doc_id * 3 + {k} * 5 + doc_id % (11 + {k})) % 7) - 1 AS mu{k}')},
    {each('1 / (1.5::DOUBLE + (doc_id + 2 * {k}) % 3) AS sig{k}')} FROM docs),
dlog AS (SELECT *, {each(psi('a{k}') + ' - ln(b{k}) AS z{k}')} FROM doc)"""

SCORES = f"""
scores AS (SELECT doc_id, term_id, cnt, {each('l{k} + z{k} AS s{k}')}
           FROM tok JOIN tlog USING (term_id) JOIN dlog USING (doc_id)),
tops AS (SELECT *, greatest({each('s{k}')}) AS top FROM scores),
weights AS (SELECT *, {each('exp(s{k} - top) AS w{k}')} FROM tops),
resp AS (SELECT *, {each('w{k} / (' + each('w{k}', ' + ') + ') AS r{k}')} FROM weights)"""

STATE = (CORPUS, TOPIC_STATE, DOC_STATE)


# --- k-means ------------------------------------------------------------------------------------------

FREQ = """
freq AS (SELECT doc_id, term_id, cnt::DOUBLE / num_words AS x FROM tok JOIN docs USING (doc_id))"""
SEEDS = f"""
seeds AS (SELECT row_number() OVER (ORDER BY key, doc_id) - 1 AS k, doc_id
          FROM (SELECT doc_id, md5('0|' || doc_id) AS key FROM docs WHERE num_words > 0)
          ORDER BY key, doc_id LIMIT {K})"""
CENT0 = f"""
cent0 AS (SELECT term_id, {each('coalesce(sum(x) FILTER (WHERE k = {k}), 0) AS c{k}')}
          FROM freq JOIN seeds USING (doc_id) GROUP BY term_id)"""


def kmeans_pass(source: str, tag: int) -> str:
    """Distances, assignment and means from the centroids in ``source``."""
    return f"""
alone{tag} AS (SELECT {each('sum(abs(c{k})) AS s{k}')} FROM {source}),
dist{tag} AS (SELECT doc_id, {each('any_value(s{k}) + sum(abs(x - coalesce(c{k}, 0)) - abs(coalesce(c{k}, 0))) AS d{k}')}
          FROM freq LEFT JOIN {source} USING (term_id), alone{tag} GROUP BY doc_id),
near{tag} AS (SELECT doc_id, list_position(ds, list_min(ds)) - 1 AS k
          FROM (SELECT doc_id, [{each('round(d{k}, 9)')}] AS ds FROM dist{tag})),
size{tag} AS (SELECT k, count(*) AS size FROM near{tag} GROUP BY k),
mean{tag} AS (SELECT k, term_id, sum(x) / any_value(size) AS value
          FROM freq JOIN near{tag} USING (doc_id) JOIN size{tag} USING (k) GROUP BY k, term_id),
cent{tag} AS (SELECT term_id, {each('coalesce(sum(value) FILTER (WHERE k = {k}), 0) AS c{k}')}
          FROM mean{tag} GROUP BY term_id)"""


KMEANS = (CORPUS, FREQ, SEEDS, CENT0, kmeans_pass("cent0", 1))
RANKS = f"""
ranks AS (SELECT k, coalesce(size, 0) AS size, row_number() OVER (ORDER BY coalesce(size, 0) DESC, k) - 1 AS rank
          FROM (SELECT unnest(range({K})) AS k) LEFT JOIN size1 USING (k))"""
# gamma = D / 2, so the flat part is one half
INIT = f"""
scale AS (SELECT 0.5 * (max(term_id) + 1) AS gamma FROM tok),
ranked AS (SELECT rank, term_id, value FROM mean1 JOIN ranks USING (k)),
centred AS (SELECT term_id, {each('coalesce(sum(value) FILTER (WHERE rank = {k}), 0) AS c{k}')}
          FROM ranked GROUP BY term_id),
topic AS (SELECT term_id, {each('0.5 + gamma * coalesce(c{k}, 0) AS g{k}')}
          FROM (SELECT DISTINCT term_id FROM tok) LEFT JOIN centred USING (term_id), scale),
tots AS (SELECT {each('sum(g{k}) AS t{k}')} FROM topic),
tpsi AS MATERIALIZED (SELECT {each(psi('t{k}') + ' AS p{k}')} FROM tots),
tlog AS (SELECT term_id, {each(psi('g{k}') + ' - p{k} AS l{k}')} FROM topic, tpsi)"""
# in the first iteration every document has the same E[ln Z] for all topics, which cancels
FIRST = f"""
dlog AS (SELECT doc_id, {each('0::DOUBLE AS z{k}')} FROM docs)"""
FIT = (*KMEANS, RANKS, INIT, FIRST, SCORES)
FIT_DOCS = f"""
ns AS (SELECT doc_id, {each('sum(cnt * r{k}) AS n{k}')} FROM resp GROUP BY doc_id)"""


# --- bound --------------------------------------------------------------------------------------------


def bound_parts() -> dict[str, str]:
    flat_total = "0.5::DOUBLE"
    tokens = (
        f"SELECT -sum(cnt * ({each('CASE WHEN r{k} > 0 THEN r{k} * ln(r{k}) ELSE 0 END', ' + ')})) AS token_entropy,"
        f" sum(cnt * ({each('r{k} * s{k}', ' + ')})) AS token_loglik FROM resp"
    )
    topics = (
        f"SELECT {K} * (lgamma(0.5 * d) - d * lgamma({flat_total})) - 0.5 * el AS topic_prior,"
        f" lg - ({each('lgamma(t{k})', ' + ')}) - wl AS topic_entropy FROM (SELECT"
        f" count(*) AS d, sum({each('l{k}', ' + ')}) AS el, sum({each('lgamma(g{k})', ' + ')}) AS lg,"
        f" sum({each('(g{k} - 1) * l{k}', ' + ')}) AS wl FROM topic JOIN tlog USING (term_id)), tots"
    )
    entropy = "a{k} - ln(b{k}) + lgamma(a{k}) + (1 - a{k}) * (" + psi("a{k}") + ")"
    docs = (
        f"SELECT sum({each(entropy, ' + ')}) AS weight_entropy,"
        f" -sum(num_words * ln({each('a{k} / b{k}', ' + ')})) AS normaliser,"
        f" -sum({each('a{k} / b{k} * exp(mu{k} + sig{k} / 2)', ' + ')}) AS weight_rate FROM doc"
    )
    prior = nums("{v} * mu{k} - lgamma({v}) + ({v} - 1) * z{k}", BETA * WEIGHTS)
    sticks = (K - 1) * np.log(ALPHA) + (ALPHA - 1) * np.log(1 - STICKS[:-1]).sum()
    global_ = f"SELECT sum({prior}) AS weight_prior, {num(sticks)} AS stick_prior FROM dlog"
    inv = np.linalg.inv(COVARIANCE)
    off = [f"(mu{k} - {num(MEAN[k])})" for k in KS]
    form = " + ".join(f"{num(inv[i, j])} * {off[i]} * {off[j]}" for i in KS for j in KS)
    trace = nums("{v} * sig{k}", np.diag(inv))
    gaussian = (
        f"SELECT sum(-0.5 * ({form}) - 0.5 * ({trace}) + 0.5 * ({each('ln(sig{k})', ' + ')})"
        f" + {num(K / 2 - 0.5 * np.linalg.slogdet(COVARIANCE)[1])}) AS gaussian FROM doc"
    )
    return {"tokens": tokens, "topics": topics, "docs": docs, "global": global_, "gaussian": gaussian}


BOUND_COLUMNS = {
    "tokens": ["token_entropy", "token_loglik"],
    "topics": ["topic_prior", "topic_entropy"],
    "docs": ["weight_entropy", "normaliser", "weight_rate"],
    "global": ["weight_prior", "stick_prior"],
    "gaussian": ["gaussian"],
}


def bound_part(name: str) -> str:
    columns = ", ".join(f"{r(c, 2)} AS {c}" for c in BOUND_COLUMNS[name])
    return with_(*STATE, SCORES, f"part AS ({bound_parts()[name]})", select=f"SELECT {columns} FROM part")


def bound_total() -> str:
    parts = [f"p_{name} AS ({text})" for name, text in bound_parts().items()]
    names = [c for columns in BOUND_COLUMNS.values() for c in columns]
    columns = ", ".join(f"{r(c, 2)} AS {c}" for c in names)
    source = ", ".join(f"p_{name}" for name in BOUND_COLUMNS)
    return with_(*STATE, SCORES, *parts, select=f"SELECT {columns}, {r(' + '.join(names), 2)} AS bound FROM {source}")


# --- the normal step of a document -------------------------------------------------------------------


def normal_update() -> str:
    """Every step of the ladder as a row; the first that helps, and shorter ones while they help more."""
    inv = np.linalg.inv(COVARIANCE)
    bp = BETA * WEIGHTS
    pull = [f"(a{k} / b{k} * exp(mu{k} + 0.5 * sig{k}))" for k in KS]
    back = [" + ".join(f"{num(inv[j, k])} * (mu{j} - {num(MEAN[j])})" for j in KS) for k in KS]
    slopes = ", ".join(
        f"{num(bp[k])} - {pull[k]} - ({back[k]}) AS dm{k}, 0.5 - 0.5 * sig{k} * ({pull[k]} + {num(inv[k, k])}) AS ds{k}"
        for k in KS
    )
    terms = " + ".join(
        f"{num(bp[k])} * m{k} - a{k} / b{k} * exp(least(m{k} + 0.5 * exp(s{k}), 700)) - 0.5 * {num(inv[k, k])} * exp(s{k}) + 0.5 * s{k}"
        for k in KS
    )
    form = " + ".join(f"{num(inv[i, j])} * (m{i} - {num(MEAN[i])}) * (m{j} - {num(MEAN[j])})" for i in KS for j in KS)
    return with_(
        *STATE,
        f"slope AS (SELECT doc_id, {each('a{k}, b{k}, mu{k}, sig{k}')}, {slopes} FROM doc)",
        "ladder AS (SELECT *, CASE WHEN t = 0 THEN 0 ELSE 2.0::DOUBLE ^ (3 - t) END AS step FROM slope, range(43) AS r(t))",
        f"""tried AS (SELECT doc_id, t, a0, b0, a1, b1, a2, b2, {each('mu{k} + step * dm{k} AS m{k}')},
             {each('least(ln(sig{k}) + step * ds{k}, 700) AS s{k}')} FROM ladder)""",
        f"valued AS (SELECT doc_id, t, {terms} - 0.5 * ({form}) AS value FROM tried)",
        """seen AS (SELECT doc_id, t, value, lag(value) OVER (PARTITION BY doc_id ORDER BY t) AS before,
             first_value(value) OVER (PARTITION BY doc_id ORDER BY t) AS start FROM valued)""",
        "firsts AS (SELECT doc_id, min(t) AS f FROM seen WHERE t > 0 AND value > start GROUP BY doc_id)",
        """ends AS (SELECT doc_id, min(t) AS e FROM seen JOIN firsts USING (doc_id)
             WHERE t > f AND NOT value > before GROUP BY doc_id)""",
        """chosen AS (SELECT doc_id, 2.0::DOUBLE ^ (3 - (coalesce(e, 43) - 1)) AS step
             FROM firsts LEFT JOIN ends USING (doc_id))""",
        select=f"SELECT doc_id, {each(r('mu{k} + coalesce(step, 0) * dm{k}') + ' AS mu{k}')},"
        f" {each(r('exp(ln(sig{k}) + coalesce(step, 0) * ds{k})') + ' AS sig{k}')}"
        " FROM slope LEFT JOIN chosen USING (doc_id)",
    )


# --- matrices -----------------------------------------------------------------------------------------

CELLS = """
a AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS value FROM embeddings),
x AS (SELECT j AS i, max(value) AS value FROM a GROUP BY j),
low AS (SELECT j AS i, min(value) AS value FROM a GROUP BY j)"""


def matrix_elementwise() -> str:
    parts = {
        "product": "SELECT a.i, a.j, a.value * b.value AS value FROM a JOIN b USING (i, j)",
        "difference": "SELECT a.i, a.j, a.value - coalesce(b.value, 0) AS value FROM a LEFT JOIN b USING (i, j)",
        "scaled": "SELECT i, j, value * 2.5::DOUBLE AS value FROM a",
        "absolute": "SELECT i, j, abs(value) AS value FROM a",
        "column": "SELECT i, j, value FROM a WHERE j = 7",
        "vector_product": "SELECT i, 0 AS j, x.value * low.value AS value FROM x JOIN low USING (i)",
        "vector_difference": "SELECT i, 0 AS j, x.value - low.value AS value FROM x JOIN low USING (i)",
        "vector_norm": "SELECT i, 0 AS j, value / (SELECT sqrt(sum(value * value)) FROM x) AS value FROM x",
        "dot": "SELECT 0 AS i, 0 AS j, sum(x.value * low.value) AS value FROM x JOIN low USING (i)",
    }
    select = "\nUNION ALL\n".join(
        f"SELECT '{name}' AS op, i::BIGINT AS i, j::BIGINT AS j, {r('value')} AS value FROM ({text})"
        for name, text in parts.items()
    )
    b = "b AS (SELECT i, j, abs(value) AS value FROM a WHERE abs(value) > 0.05)"
    return with_(CELLS, b, select=select)


def all_oracles() -> dict[str, str]:
    arguments = "args AS (SELECT doc_id, term_id, cnt * 0.25::DOUBLE + (term_id % 97) / 10.0::DOUBLE + 0.05::DOUBLE AS x FROM tok)"
    out = {
        "corpus_from_text": with_(CORPUS, select="SELECT doc_id, term, cnt FROM pairs"),
        "corpus_vocabulary": with_(CORPUS, select="SELECT term, term_id, n FROM vocab"),
        "corpus_read_counts": with_(CORPUS, select="SELECT doc_id, term_id, cnt FROM tok"),
        "corpus_stats": with_(
            CORPUS,
            select="SELECT count(*) AS num_docs, sum(num_words)::BIGINT AS num_words,"
            " (SELECT max(term_id) + 1 FROM tok) AS vocab_size FROM docs",
        ),
        "corpus_doc_stats": with_(CORPUS, select="SELECT doc_id, num_words, num_unique FROM docs"),
        "corpus_check": with_(
            CORPUS,
            """
raw AS (SELECT doc_id * 2 + term_id % 2 AS doc_id, term_id // 4 - (CASE WHEN term_id % 4 < 0 THEN 1 ELSE 0 END) - 3 AS t,
        cnt - 1 AS c FROM tok),
declared AS (SELECT unnest([doc_id * 2, doc_id * 2 + 1]) AS doc_id, num_unique // 2 AS declared FROM docs),
written AS (SELECT doc_id, any_value(declared) AS declared, count(t) AS n
            FROM declared LEFT JOIN raw USING (doc_id) GROUP BY doc_id)""",
            select="""SELECT doc_id, t AS term_id, 'count_not_positive' AS problem, count(*) AS n
FROM raw WHERE c <= 0 GROUP BY doc_id, t
UNION ALL SELECT doc_id, t, 'negative_id', count(*) FROM raw WHERE t < 0 GROUP BY doc_id, t
UNION ALL SELECT doc_id, t, 'repeated_term', count(*) FROM raw GROUP BY doc_id, t HAVING count(*) > 1
UNION ALL SELECT doc_id, -1000000, 'empty_document', n FROM written WHERE n = 0
UNION ALL SELECT doc_id, -1000000, 'declared_differs', n FROM written WHERE declared <> n""",
        ),
        "matrix_read": with_(CELLS, select="SELECT i, j, round(value, 6) AS value FROM a"),
        "matrix_export": with_(
            CELLS,
            select="SELECT i, string_agg(printf('%.6f', value), ',' ORDER BY j) || ',' AS line FROM a GROUP BY i",
        ),
        "model_save_load": with_(
            *FIT,
            select="SELECT term_id, "
            + each(r("0.5 + sum(cnt * r{k})") + " AS gam{k}")
            + " FROM resp GROUP BY term_id",
        ),
        "doc_term_freq": with_(CORPUS, FREQ, select="SELECT doc_id, term_id, x AS freq FROM freq"),
        "fn_digamma": with_(CORPUS, arguments, select=f"SELECT doc_id, term_id, {r(psi('x'))} AS value FROM args"),
        "fn_lgamma": with_(CORPUS, arguments, select=f"SELECT doc_id, term_id, {r('lgamma(x)')} AS value FROM args"),
        "doc_elnz": with_(*STATE, select=f"SELECT doc_id, {each(r('z{k}') + ' AS elnz{k}')} FROM dlog"),
        # needs the vocabulary only: no counts, no documents, totals by scalar subqueries
        "topic_elneta": with_(
            r"""terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents)""",
            "ids AS MATERIALIZED (SELECT row_number() OVER (ORDER BY term) - 1 AS term_id FROM terms)",
            f"gams AS MATERIALIZED (SELECT term_id, {each('(1 + (term_id * 7 + 3 * {k}) % 5)::DOUBLE AS g{k}')} FROM ids)",
            f"tots AS MATERIALIZED (SELECT {each(psi('sum(g{k})') + ' AS p{k}')} FROM gams)",
            # a parameter takes one of five values, so its digamma is taken five times
            f"logs AS MATERIALIZED (SELECT g, {psi('g')} AS l FROM (SELECT unnest([1, 2, 3, 4, 5])::DOUBLE AS g))",
            select="SELECT term_id, "
            + each(r("(SELECT max(l) FROM logs WHERE g = g{k}) - (SELECT p{k} FROM tots)") + " AS elneta{k}")
            + " FROM gams",
        ),
        "token_scores": with_(
            *STATE, SCORES, select=f"SELECT doc_id, term_id, cnt, {each(r('s{k}') + ' AS score{k}')} FROM scores"
        ),
        "token_responsibilities": with_(
            *STATE, SCORES, select=f"SELECT doc_id, term_id, cnt, {each(r('r{k}') + ' AS r{k}')} FROM resp"
        ),
        "topic_term_update": with_(
            *STATE,
            SCORES,
            select=f"SELECT term_id, {each(r('0.5 + sum(cnt * r{k})') + ' AS gam{k}')} FROM resp GROUP BY term_id",
        ),
        "doc_topic_counts": with_(
            *STATE, SCORES, select=f"SELECT doc_id, {each(r('sum(cnt * r{k})') + ' AS n{k}')} FROM resp GROUP BY doc_id"
        ),
        "kmeans_seed_docs": with_(CORPUS, SEEDS, select="SELECT k::INTEGER AS k, doc_id FROM seeds"),
        "kmeans_distance": with_(*KMEANS, select=f"SELECT doc_id, {each(r('d{k}') + ' AS d{k}')} FROM dist1"),
        "kmeans_assign": with_(*KMEANS, select="SELECT doc_id, k::INTEGER AS k FROM near1"),
        "kmeans_centroids": with_(
            *KMEANS, select=f"SELECT k::INTEGER AS k, term_id, {r('value', 9)} AS value FROM mean1"
        ),
        "kmeans_relabel": with_(
            *KMEANS, RANKS, select="SELECT k::INTEGER AS k, size, rank::INTEGER AS rank FROM ranks"
        ),
        "kmeans_fit": with_(
            *KMEANS, kmeans_pass("cent1", 2), select=f"SELECT term_id, {each(r('c{k}', 9) + ' AS c{k}')} FROM cent2"
        ),
        "topic_init": with_(
            *KMEANS, RANKS, INIT, select=f"SELECT term_id, {each(r('g{k}') + ' AS gam{k}')} FROM topic"
        ),
        "doc_gamma_update": with_(
            *STATE,
            select="SELECT doc_id, "
            + nums(r("n{k} + {v}") + " AS a{k}", BETA * WEIGHTS, ", ")
            + ", "
            + each(
                r("num_words / (" + each("a{k} / b{k}", " + ") + ") + exp(mu{k} + sig{k} / 2)")
                + " AS b{k}"
            )
            + " FROM doc",
        ),
        "doc_normal_update": normal_update(),
        "topic_global_stats": with_(
            *STATE,
            select=f"SELECT count(*) AS num_docs, {each(r('sum(mu{k})') + ' AS mu{k}')},"
            f" {each(r('sum(z{k})') + ' AS lnz{k}')} FROM dlog",
        ),
        "topic_mean": with_(
            *STATE,
            select=" UNION ALL ".join(f"SELECT {k}::INTEGER AS k, {r(f'avg(mu{k})', 8)} AS u FROM doc" for k in KS),
        ),
        "topic_covariance": with_(
            *STATE,
            select=" UNION ALL ".join(
                f"SELECT {i}::INTEGER AS i, {j}::INTEGER AS j, "
                + r(f"covar_pop(mu{i}, mu{j})" + (f" + avg(sig{i})" if i == j else ""), 8)
                + " AS value FROM doc"
                for i in KS
                for j in KS
            ),
        ),
        "stick_weights": with_(
            *STATE,
            "v AS (SELECT doc_id, a0 / (a0 + 3) AS v0, a1 / (a1 + 3) AS v1, 0.9::DOUBLE AS v2 FROM doc)",
            select=" UNION ALL ".join(
                f"SELECT doc_id AS group_id, {k}::INTEGER AS k, {r(f'v{k}')} AS v, {r(left)} AS \"left\","
                f" {r(f'v{k} * {left}')} AS p FROM v"
                for k, left in enumerate(("1::DOUBLE", "(1 - v0)", "((1 - v0) * (1 - v1))"))
            ),
        ),
        "topics_hdp_fit": with_(
            *FIT,
            FIT_DOCS,
            select=f"SELECT doc_id, {each(r('coalesce(n{k}, 0)') + ' AS n{k}')},"
            f" {each(r(f'coalesce(n{{k}}, 0) + {num(BETA / K)}') + ' AS a{k}')},"
            f" {each(r(f'num_words / {num(K)} + 1') + ' AS b{k}')} FROM docs LEFT JOIN ns USING (doc_id)",
        ),
        "fold_in": with_(
            *STATE[:2],
            FIRST,
            SCORES,
            FIT_DOCS,
            select=f"SELECT doc_id, {each(r('coalesce(n{k}, 0)') + ' AS n{k}')}, "
            + nums(r("coalesce(n{k}, 0) + {v}") + " AS a{k}", BETA * WEIGHTS, ", ")
            + f", {each(r(f'num_words / {num(K)} + 1') + ' AS b{k}')} FROM docs LEFT JOIN ns USING (doc_id)",
        ),
        "heldout_split": with_(
            CORPUS,
            """
tokens AS (SELECT doc_id, term_id, unnest(range(1, cnt + 1)) AS copy FROM tok),
ranked AS (SELECT doc_id, term_id, row_number() OVER (
               PARTITION BY doc_id ORDER BY md5('0|' || doc_id || '|' || term_id || '|' || copy), term_id, copy) AS rank
           FROM tokens),
parts AS (SELECT doc_id, term_id, CASE WHEN rank <= floor(num_words * 0.5) THEN 'test' ELSE 'train' END AS part
          FROM ranked JOIN docs USING (doc_id))""",
            select="SELECT doc_id, term_id, part, count(*) AS cnt FROM parts GROUP BY doc_id, term_id, part",
        ),
        "heldout_loglik_plugin": with_(*STATE, PLUGIN, select=f"SELECT doc_id, words, {r('loglik', 5)} AS loglik FROM plugin"),
        "heldout_summary": with_(
            *STATE,
            PLUGIN,
            select=f"SELECT {r('sum(loglik) / sum(words)', 8)} AS per_word, {r('avg(loglik / words)', 8)} AS doc_mean,"
            f" {r('stddev_samp(loglik / words)', 8)} AS doc_std FROM plugin",
        ),
        "log_mean_exp": with_(
            CORPUS, FREQ, select=f"SELECT doc_id, {r('ln(avg(x))', 8)} AS loglik FROM freq GROUP BY doc_id"
        ),
        "matrix_vector": with_(
            CELLS,
            "ax AS (SELECT a.i, sum(a.value * x.value) AS value FROM a JOIN x ON a.j = x.i GROUP BY a.i)",
            "atax AS (SELECT a.j AS i, sum(a.value * ax.value) AS value FROM a JOIN ax USING (i) GROUP BY a.j)",
            select=f"SELECT 'ax' AS op, i, {r('value')} AS value FROM ax"
            f" UNION ALL SELECT 'atax', i, {r('value')} FROM atax",
        ),
        "matrix_multiply": with_(
            CELLS,
            "b AS (SELECT a.j AS i, label::BIGINT AS j, sum(value) AS value FROM a JOIN embeddings ON vec_id = a.i GROUP BY a.j, label)",
            select=f"SELECT a.i, b.j, {r('sum(a.value * b.value)', 5)} AS value FROM a JOIN b ON a.j = b.i GROUP BY a.i, b.j",
        ),
        "matrix_gram": with_(
            CELLS,
            select=f"SELECT l.j AS i, r.j AS j, {r('sum(l.value * r.value)')} AS value"
            " FROM a AS l JOIN a AS r USING (i) GROUP BY l.j, r.j",
        ),
        "matrix_multiply_terms": with_(
            CORPUS,
            "langs AS (SELECT doc_id, ascii(lang)::BIGINT AS j FROM documents)",
            "b AS (SELECT term_id, j, sum(cnt)::DOUBLE AS value FROM tok JOIN langs USING (doc_id) GROUP BY term_id, j)",
            select=f"SELECT tok.doc_id AS i, b.j, {r('sum(tok.cnt * b.value)', 3)} AS value"
            " FROM tok JOIN b USING (term_id) GROUP BY tok.doc_id, b.j",
        ),
        "matrix_gram_terms": with_(
            CORPUS,
            select=f"SELECT x.doc_id AS i, y.doc_id AS j, {r('sum(x.cnt * y.cnt)::DOUBLE', 3)} AS value"
            " FROM tok AS x JOIN tok AS y USING (term_id) GROUP BY x.doc_id, y.doc_id",
        ),
        "matrix_sums": with_(
            CELLS,
            select=f"SELECT 1::INTEGER AS dim, j AS i, {r('sum(value)')} AS value FROM a GROUP BY j"
            f" UNION ALL SELECT 2, i, {r('sum(value)')} FROM a GROUP BY i",
        ),
        "matrix_normalize": with_(
            CELLS,
            select=f"SELECT 1::INTEGER AS dim, i, j, {r('value / sqrt(sum(value * value) OVER (PARTITION BY j))')} AS value FROM a"
            f" UNION ALL SELECT 2, i, j, {r('value / sqrt(sum(value * value) OVER (PARTITION BY i))')} FROM a",
        ),
        "matrix_elementwise": matrix_elementwise(),
        "bound_total": bound_total(),
    }
    for name in BOUND_COLUMNS:
        out[f"bound_{name}"] = bound_part(name)
    return out


PLUGIN = f"""
mean_topic AS (SELECT term_id, {each('g{k} / t{k} AS e{k}')} FROM topic, tots),
ratio AS (SELECT doc_id, {each('a{k} / b{k} AS q{k}')} FROM doc),
plugin AS (SELECT doc_id, sum(cnt)::BIGINT AS words,
           sum(cnt * ln(({each('e{k} * q{k}', ' + ')}) / ({each('q{k}', ' + ')}))) AS loglik
           FROM tok JOIN mean_topic USING (term_id) JOIN ratio USING (doc_id) GROUP BY doc_id)"""
