"""Pieces of the check SQL that queries share: the adapters' tables and the scalar expressions."""

from __future__ import annotations

from storyspark.adapters import NOW, PHRASES
from storyspark.config import RELEASE_WORDS, SIMILARITY_STOP_WORDS, TRACKING_PARAMS, UPDATE_WORDS


def words(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\n\r\f]+', ' ', 'g'))"


def strip_html(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for pattern, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "''"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"regexp_replace({x}, '{pattern}', '{plain}', 'gi')"
    return squeeze(x)


def host(u: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(regexp_extract(trim({u}), '^(?i:https?)://([^/?#]*)', 1)), ':\d+$', ''), '^www\.', '')"


def canonical(u: str) -> str:
    scheme = f"lower(regexp_extract(trim({u}), '^(?i:(https?))://', 1))"
    port = f"regexp_replace(lower(regexp_extract(trim({u}), '^(?i:https?)://([^/?#]*)', 1)), CASE {scheme} WHEN 'http' THEN ':80$' ELSE ':443$' END, '')"
    path = f"regexp_extract(trim({u}), '^(?i:https?)://[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract(trim({u}), '^(?i:https?)://[^/?#]*[^?#]*[?]([^#]*)', 1)"
    left = f"array_to_string(list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT list_contains({words(TRACKING_PARAMS)}, lower(split_part(p, '=', 1))) AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_')), '&')"
    whole = rf"({scheme} || '://' || regexp_replace({port}, '^www\.', '') || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {left} = '' THEN '' ELSE '?' || {left} END)"
    return f"CASE WHEN ends_with({whole}, '/') AND {path} NOT IN ('', '/') THEN left({whole}, length({whole}) - 1) ELSE {whole} END"


def headline(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def tokens(x: str) -> str:
    kept = f"list_filter(string_split({headline(f'coalesce({x}, {chr(39) * 2})')}, ' '), lambda t: length(t) > 1 AND NOT list_contains({words(SIMILARITY_STOP_WORDS)}, t))"
    stem = f"CASE WHEN list_contains({words(RELEASE_WORDS)}, t) THEN 'release_event' WHEN list_contains({words(UPDATE_WORDS)}, t) THEN 'update_event' WHEN length(t) > 4 AND ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN left(t, length(t) - 1) ELSE t END"
    return f"list_transform({kept}, lambda t: {stem})"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE {both} / (len({a}) + len({b}) - {both}) END"


def containment(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b})) / least(len({a}), len({b})) END"


def title_score(a: str, b: str) -> str:
    return f"greatest({jaccard(f'{a}.tt', f'{b}.tt')}, {containment(f'{a}.tt', f'{b}.tt')} * 0.92::DOUBLE)"


def significant_score(a: str, b: str) -> str:
    return f"CASE WHEN len({a}.sig) = 0 OR len({b}.sig) = 0 THEN 0.0::DOUBLE ELSE {containment(f'{a}.sig', f'{b}.sig')} END"


def lexical(a: str, b: str) -> str:
    snippet = f"CASE WHEN {a}.has OR {b}.has THEN greatest({jaccard(f'{a}.st', f'{b}.st')}, {containment(f'{a}.st', f'{b}.st')} * 0.9::DOUBLE) ELSE 0.0::DOUBLE END"
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {title_score(a, b)} * 0.7::DOUBLE + {snippet} * 0.2::DOUBLE + {significant_score(a, b)} * 0.1::DOUBLE))"


def rnd(x: str, k: int = 4) -> str:
    return f"floor(({x}) * {10.0**k}::DOUBLE + 0.5::DOUBLE) / {10.0**k}::DOUBLE"


def tier_score(t: str) -> str:
    return f"CASE {t} WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END"


PHRASE = "CASE topic " + " ".join(f"WHEN '{t}' THEN '{p}'" for t, p in PHRASES.items()) + " ELSE topic END"
NOW_TS = f"TIMESTAMP '{NOW}'"

ARTICLES = r"""
art AS (
  SELECT d.doc_id AS ordinal,
    'https://' || CASE WHEN doc_id % 3 = 1 THEN 'www.' ELSE '' END || 'copy.example.com/' || left(md5(text), 12) || CASE WHEN doc_id % 3 = 0 THEN '?utm_source=feed' ELSE '' END AS url,
    array_to_string(w[1:12], ' ') AS title, array_to_string(w[13:52], ' ') AS snippet,
    source AS source_name, lang AS topic, CASE WHEN doc_id % 17 <> 0 THEN e.ts END AS published_at
  FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '') AS w FROM documents) d JOIN events e ON d.doc_id = e.event_id
)"""
_N = "CASE WHEN starts_with(source_name, 'src') AND length(source_name) = 4"
NORMALIZED = (
    ARTICLES
    + f"""
, norm AS (
  SELECT ordinal, trim(url) AS url, {canonical('url')} AS canonical_url, trim(title) AS title, {headline('title')} AS normalized_title, nullif(trim(snippet), '') AS snippet,
    coalesce(nullif(trim(source_name), ''), 'Unknown') AS source_name, topic, published_at,
    CASE WHEN source_name IN ('src0','src1','src2','src3','src4') THEN 1 WHEN source_name IN ('src5','src6','src7','src8','src9') THEN 2 ELSE 3 END AS source_tier,
    CASE WHEN source_name IN ('src0','src1') THEN 'group-a' WHEN source_name IN ('src5','src6') THEN 'group-b' ELSE {host('url')} END AS publisher_id
  FROM art WHERE trim(title) <> ''
)"""
)
DEDUPED = (
    NORMALIZED
    + f"""
, dedup AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY {tier_score('source_tier')} DESC, length(coalesce(snippet, '')) DESC, coalesce(epoch_us(published_at), 0) DESC, ordinal) AS rn FROM norm) WHERE rn = 1
)"""
)
PAIRED = (
    DEDUPED
    + f"""
, feat AS (
  SELECT *, list_filter(tt, lambda t: length(t) >= 4 OR t = 'ai' OR ends_with(t, '_event')) AS sig
  FROM (SELECT *, list_distinct({tokens('title')}) AS tt, list_distinct({tokens('snippet')}) AS st, coalesce(snippet <> '', false) AS has FROM dedup)
), scored AS (
  SELECT a.ordinal AS a, b.ordinal AS b, {lexical('a', 'b')} AS score FROM feat a JOIN feat b ON a.topic = b.topic AND a.ordinal < b.ordinal
), pairs AS (SELECT * FROM scored WHERE score >= 0.5)"""
)
CLUSTERED = (
    PAIRED
    + """
, edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs)
, reach AS (SELECT ordinal, ordinal AS r FROM dedup UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.ordinal)
, comp AS (SELECT ordinal, min(r) AS cluster_no FROM reach GROUP BY ordinal)
, members AS (SELECT f.*, c.cluster_no FROM feat f JOIN comp c USING (ordinal))"""
)
TOPIC_TOKENS = f"list_filter(regexp_split_to_array(lower({PHRASE}), '[^a-z0-9]+'), lambda t: length(t) > 2)"
TEXT = "lower(title || ' ' || coalesce(snippet, ''))"
RELEVANCE = f"CASE WHEN len({TOPIC_TOKENS}) = 0 THEN 1.0::DOUBLE ELSE len(list_filter({TOPIC_TOKENS}, lambda t: contains({TEXT}, t))) / len({TOPIC_TOKENS}) END"
FRESHNESS = f"CASE WHEN latest IS NULL THEN 0.15::DOUBLE ELSE pow(0.5::DOUBLE, greatest(0.0::DOUBLE, (epoch_us({NOW_TS}) - epoch_us(latest)) / 3.6e9) / 24.0::DOUBLE) END"
SCORED = (
    CLUSTERED
    + f"""
, reps AS (
  SELECT cluster_no, ordinal AS representative, title AS rep_title, url AS rep_url, source_name AS rep_source FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster_no ORDER BY {tier_score('source_tier')} DESC, coalesce(epoch_us(published_at), 0) DESC, length(coalesce(snippet, '')) DESC, ordinal) AS rn FROM members) WHERE rn = 1
), cohesion AS (
  SELECT m.cluster_no, coalesce(max(p.mean), 1.0::DOUBLE) AS similarity_score FROM (SELECT DISTINCT cluster_no FROM members) m LEFT JOIN (
    SELECT a.cluster_no, {rnd(f"CAST(sum(CAST({rnd(lexical('a', 'b'), 9)} AS DECIMAL(20,9))) AS DOUBLE) / count(*)")} AS mean
    FROM members a JOIN members b ON a.cluster_no = b.cluster_no AND a.ordinal < b.ordinal GROUP BY a.cluster_no) p USING (cluster_no) GROUP BY m.cluster_no
), per AS (
  SELECT cluster_no, lower(trim(source_name)) AS source, max({tier_score('source_tier')}) AS best, max(published_at) AS latest, max({RELEVANCE}) AS relevance FROM members GROUP BY ALL
), parts AS (
  SELECT cluster_no, relevance, {FRESHNESS} AS freshness, least(1.0::DOUBLE, sources / 5) AS diversity, quality FROM (
    SELECT cluster_no, max(relevance) AS relevance, max(latest) AS latest, count(*) FILTER (source <> '') AS sources, CAST(sum(CAST(best AS DECIMAL(20,6))) AS DOUBLE) / count(*) AS quality FROM per GROUP BY cluster_no)
), scores AS (
  SELECT cluster_no, {rnd('relevance')} AS relevance, {rnd('freshness')} AS freshness, {rnd('diversity')} AS diversity, {rnd('quality')} AS quality,
    {rnd(' + '.join(f'{c} * {w!r}::DOUBLE' for c, w in zip(('relevance', 'freshness', 'diversity', 'quality'), [x / (0.35 + 0.25 + 0.2 + 0.2) for x in (0.35, 0.25, 0.2, 0.2)])))} AS importance FROM parts
), pubs AS (
  SELECT cluster_no, publisher_id, max({tier_score('source_tier')}) AS q, min(ordinal) AS o FROM members GROUP BY ALL
), verif AS (
  SELECT m.cluster_no, source_count, independent_count, quality, latest, first_reporter, similarity_score FROM (
    SELECT cluster_no, count(DISTINCT nullif(trim(source_name), '')) AS source_count, max(published_at) AS latest,
      first(source_name ORDER BY published_at IS NULL, coalesce(epoch_us(published_at), 0), ordinal) AS first_reporter FROM members GROUP BY cluster_no) m
  JOIN (SELECT cluster_no, count(*) AS independent_count, CAST(sum(CAST(q AS DECIMAL(20,6))) AS DOUBLE) / count(*) AS quality FROM pubs GROUP BY cluster_no) USING (cluster_no) JOIN cohesion USING (cluster_no)
)"""
)
LEVEL = "CASE WHEN independent_count >= 3 THEN 'well_supported' WHEN independent_count >= 2 THEN 'confirmed' ELSE 'limited' END"
HEADLINES = f"""
, rows_ AS (SELECT cluster_no, ordinal, title, {tier_score('source_tier')} AS tier, {tokens('title')} AS toks, count(*) OVER (PARTITION BY cluster_no) AS n FROM members)
, dfs AS (SELECT cluster_no, token, count(*) AS df, any_value(n) AS n FROM (SELECT cluster_no, n, unnest(list_distinct(toks)) AS token FROM rows_) GROUP BY ALL)
, shared AS (SELECT cluster_no, list(token) AS shared FROM dfs WHERE df >= greatest(1, ceil(n / 2)) GROUP BY cluster_no)
, hs AS (
  SELECT r.*, coalesce(s.shared, []) AS shared,
    (CASE WHEN len(coalesce(s.shared, [])) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(toks, lambda t: list_contains(s.shared, t))) / len(s.shared) END) * 0.55::DOUBLE + least(1.0::DOUBLE, 12.0::DOUBLE / greatest(len(toks), 1)) * 0.25::DOUBLE + tier * 0.2::DOUBLE AS score
  FROM rows_ r LEFT JOIN shared s USING (cluster_no)
), heads AS (
  SELECT b.cluster_no, CASE WHEN b.n = 1 OR o.score >= b.best - 0.05::DOUBLE THEN reps.rep_title ELSE b.best_title END AS headline FROM (
    SELECT cluster_no, any_value(n) AS n, max(score) AS best, first(title ORDER BY score DESC, ordinal) AS best_title FROM hs GROUP BY cluster_no) b
  JOIN reps USING (cluster_no) JOIN hs o ON o.cluster_no = b.cluster_no AND o.ordinal = reps.representative
)"""
STORIES = (
    SCORED
    + HEADLINES
    + f"""
, clusters AS (
  SELECT m.topic, m.cluster_no, left(sha256(string_agg(canonical_url, '|' ORDER BY canonical_url)), 16) AS cluster_id, min(published_at) AS first_published_at, max(published_at) AS latest_published_at,
    count(*) AS article_count, CAST(count(DISTINCT source_name) AS INTEGER) AS source_count, array_to_string(list_sort(list_distinct(list(source_name))), ',') AS sources,
    string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY coalesce(epoch_us(published_at), 0) DESC, ordinal) AS article_ids
  FROM members m GROUP BY ALL
), stories AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY importance DESC, freshness DESC, independent_count DESC, source_count DESC, cluster_id) AS rank
  FROM clusters JOIN reps USING (cluster_no) JOIN heads USING (cluster_no) JOIN scores USING (cluster_no) JOIN (SELECT cluster_no, independent_count, similarity_score, first_reporter FROM verif) USING (cluster_no)
)"""
)


def near_deduped(threshold: float) -> str:
    """``dedup`` after the collapse of near-duplicate headlines of one source, as a fold over each source's rows; ``exact`` before it."""
    return (
        DEDUPED.replace("dedup AS (", "exact AS (")
        + f"""
, near_feat AS (
  SELECT *, list_filter(tt, lambda t: length(t) >= 4 OR t = 'ai' OR ends_with(t, '_event')) AS sig FROM (SELECT *, list_distinct({tokens('title')}) AS tt FROM exact)
), near_pairs AS (
  SELECT a.ordinal AS a, b.ordinal AS b FROM near_feat a JOIN near_feat b ON a.source_name = b.source_name AND a.ordinal < b.ordinal
  WHERE {title_score('a', 'b')} * 0.7::DOUBLE + {significant_score('a', 'b')} * 0.1::DOUBLE >= {threshold}::DOUBLE
), near_rows AS (
  SELECT source_name, {{'o': ordinal, 'q': {tier_score('source_tier')}, 'l': length(coalesce(snippet, '')), 't': coalesce(epoch_us(published_at), 0)}} AS me, nb, row_number() OVER (PARTITION BY source_name ORDER BY ordinal) AS k
  FROM exact JOIN (SELECT x, list(y) AS nb FROM (SELECT a AS x, b AS y FROM near_pairs UNION ALL SELECT b, a FROM near_pairs) GROUP BY x) ON x = ordinal
), near_walk(source_name, k, slots) AS (
  SELECT source_name, CAST(1 AS BIGINT), [me] FROM near_rows WHERE k = 1
  UNION ALL
  SELECT source_name, k, CASE WHEN f IS NULL THEN list_append(slots, me) WHEN (me.q, me.l, me.t) > (slots[f].q, slots[f].l, slots[f].t) THEN list_transform(slots, lambda s, i: CASE WHEN i = f THEN me ELSE s END) ELSE slots END
  FROM (SELECT r.source_name, r.k, r.me, w.slots, list_filter(range(1, len(w.slots) + 1), lambda i: list_contains(r.nb, w.slots[i].o))[1] AS f FROM near_walk w JOIN near_rows r ON r.source_name = w.source_name AND r.k = w.k + 1)
), near_kept AS (
  SELECT unnest(slots).o AS o FROM (SELECT source_name, arg_max(slots, k) AS slots FROM near_walk GROUP BY source_name)
), dedup AS (
  SELECT * FROM exact WHERE ordinal NOT IN (SELECT me.o FROM near_rows) OR ordinal IN (SELECT o FROM near_kept)
)"""
    )
