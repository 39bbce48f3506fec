"""The catalog of tracker queries with the SQL each is compared with.

Every query reads its whole tables. Where a result cannot be put into SQL (greedy and
stateful kernels) there is none, and the tests compare with brute force instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .context import table
from .functions import confidence as conf
from .functions import coordinates as C
from .functions import geometry as G
from .functions import stats as S
from .functions import text as T
from .operators import blocks, classify, drift, lifecycle, match, merge, overlap, spatial
from .operators.blocks import side
from .plans import paragraphs, replay, reports
from .sources import captures

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

SPACES = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}"


def _sig(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9A-Za-z{CJK}]', '', 'g')"


def _norm(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{SPACES}', ' ', 'g'), '^ | $', '', 'g')"


def _coded(x: str, a: str, b: str) -> str:
    """``x`` with one byte for each letter of both texts, so that bytes count letters."""
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: chr(list_position(list_distinct(string_split({a} || {b}, '')), c)::INT)), '')"


def _dist(a: str, b: str) -> str:
    return f"CASE WHEN strlen({a}) = length({a}) AND strlen({b}) = length({b}) THEN levenshtein({a}, {b}) ELSE levenshtein({_coded(a, a, b)}, {_coded(b, a, b)}) END"


def _lev(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 1.0::DOUBLE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - ({_dist(a, b)})::DOUBLE / greatest(length({a}), length({b})) END"


def _chars(x: str) -> str:
    return f"list_filter(list_distinct(string_split({x}, '')), lambda c: c <> '')"


def _jac(a: str, b: str) -> str:
    if a.endswith(".sig"):
        f, c = a.replace(".sig", ".chars"), b.replace(".sig", ".chars")
        same = f"len(list_intersect({f}, {c}))"
        return f"CASE WHEN len({f}) + len({c}) = 0 THEN 1.0::DOUBLE ELSE {same}::DOUBLE / (len({f}) + len({c}) - {same}) END"
    both = f"len(list_intersect({_chars(a)}, {_chars(b)}))::DOUBLE"
    union = f"len({_chars(f'{a} || {b}')})"
    return f"CASE WHEN {union} = 0 THEN 1.0::DOUBLE ELSE {both} / {union} END"


def _weight(kind: str = "kind", hz: str = "hz") -> str:
    return f"CASE WHEN {kind} = 'viewport' THEN 40 WHEN {kind} = 'inner' AND {hz} >= 0 THEN 30 WHEN {kind} = 'inner' OR {hz} >= 0 THEN 20 ELSE 10 END"


def _common(f: str, c: str) -> str:
    w = f"(least({f}.r, {c}.r) - greatest({f}.l, {c}.l))"
    h = f"(least({f}.b, {c}.b) - greatest({f}.t, {c}.t))"
    return f"CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} ELSE 0 END"


def _area(x: str) -> str:
    return f"(({x}.r - {x}.l) * ({x}.b - {x}.t))"


def _near(f: str, c: str) -> str:
    """Whether two blocks are in neighbouring cells of a layer they share."""
    x = lambda p: f"round(({p}.l + ({p}.r - {p}.l) / 2) / 200)"
    y = lambda p, top="0": f"round(({p}.t + ({p}.b - {p}.t) / 2 - {top}) / 200)"
    plain = f"(({f}.kind = 'viewport') = ({c}.kind = 'viewport') AND abs({x(f)} - {x(c)}) <= 1 AND abs({y(f)} - {y(c)}) <= 1)"
    inner = f"({f}.kind = 'inner' AND {c}.kind = 'inner' AND abs({x(f)} - {x(c)}) <= 1 AND abs({y(f, f + '.inner_top')} - {y(c, c + '.inner_top')}) <= 1)"
    return f"({plain} OR {inner})"


BASE = f"""
WITH obs AS MATERIALIZED (
  SELECT session_id, cap, seq, block_id AS id, CASE WHEN isc THEN 'inner' ELSE 'page' END AS kind,
    CASE WHEN hsc THEN sc[3]::INT ELSE -1 END AS hz, cid, CASE WHEN isc THEN coalesce(sc[1], 0) ELSE 0 END AS inner_top,
    rect[1] AS l, rect[2] AS t, rect[3] AS r, rect[4] AS b, otext AS text, {_sig('otext')} AS sig, {_chars(_sig('otext'))} AS chars, pconf,
    coalesce(tconf, 0) AS tconf, coalesce(srcq, 0) AS srcq, coalesce(obsn, 1) AS obs, prov AS provisional
  FROM obs_blocks WHERE otext IS NOT NULL AND regexp_replace(otext, '{SPACES}', '', 'g') <> ''),
trk AS MATERIALIZED (
  SELECT session_id, track_id AS id, kind, hz_index AS hz, NULL::VARCHAR AS cid, 0 AS inner_top, rect[1] AS l, rect[2] AS t, rect[3] AS r,
    rect[4] AS b, text, {_sig('text')} AS sig, {_chars(_sig('text'))} AS chars, pconf, tconf, coalesce(source_quality, 0) AS srcq, obs_count AS obs, is_provisional AS provisional
  FROM tracks WHERE text IS NOT NULL)
"""

_MATCHED = f"""
, pairs AS (
  SELECT f.session_id, f.id AS f_id, c.id AS c_id, {_lev('f.sig', 'c.sig')} AS lev, {_jac('f.sig', 'c.sig')} AS jac,
    sqrt(((f.l + (f.r - f.l) / 2) - (c.l + (c.r - c.l) / 2)) ** 2 + ((f.t + (f.b - f.t) / 2) - (c.t + (c.b - c.t) / 2)) ** 2) AS dist,
    c.t AS ct, c.l AS cl, c.r AS cr, c.b AS cb
  FROM obs f JOIN trk c ON f.session_id = c.session_id AND (f.kind = 'viewport') = (c.kind = 'viewport') AND {_near('f', 'c')}
  WHERE length(f.sig) > 0 AND length(c.sig) > 0),
best AS MATERIALIZED (
  SELECT * FROM pairs WHERE lev >= 0.70 OR jac >= 0.80
  QUALIFY row_number() OVER (PARTITION BY f_id ORDER BY lev DESC, round(dist, 9), ct, cl, cr, cb, c_id) = 1)
"""

_STEP = f"""
, step AS MATERIALIZED (
  SELECT f.session_id, f.cap, f.id AS f_id, c.id AS c_id, {_lev('f.sig', 'c.sig')} AS lev, {_jac('f.sig', 'c.sig')} AS jac,
    sqrt(((f.l + (f.r - f.l) / 2) - (c.l + (c.r - c.l) / 2)) ** 2 + ((f.t + (f.b - f.t) / 2) - (c.t + (c.b - c.t) / 2)) ** 2) AS dist,
    f.kind AS f_kind, f.hz AS f_hz, c.hz AS c_hz, c.provisional AS c_prov, f.l AS fl, f.t AS ft, f.r AS fr, f.b AS fb, c.l AS cl, c.t AS ct, c.r AS cr, c.b AS cb
  FROM obs f JOIN obs c ON f.session_id = c.session_id AND c.cap = f.cap - 1 AND (f.kind = 'viewport') = (c.kind = 'viewport') AND {_near('f', 'c')}
  WHERE length(f.sig) > 0 AND length(c.sig) > 0),
held AS MATERIALIZED (
  SELECT * FROM step WHERE lev >= 0.70 OR jac >= 0.80
  QUALIFY row_number() OVER (PARTITION BY f_id ORDER BY lev DESC, round(dist, 9), ct, cl, cr, cb, c_id) = 1)
"""


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return blocks.observed(table(spark, d, "obs_blocks"))


def _trk(spark: SparkSession, d: str) -> DataFrame:
    return blocks.tracked(table(spark, d, "tracks"))


def _r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# --- text -----------------------------------------------------------------------


@query(f"""
SELECT block_id AS id, {_norm('otext')} AS normal, substr(otext, 1, 12) AS head, {_sig('otext')} AS sig,
  regexp_replace(otext, '[^{CJK}]', '', 'g') AS cjk,
  round(CASE WHEN length(otext) = 0 THEN 0 ELSE length(regexp_replace(otext, '[^{CJK}]', '', 'g'))::DOUBLE / length(otext) END, 6) AS cjk_fraction,
  right(otext, 1) IN ('。', '！', '？', '…') AS sentence_end, right(otext, 1) IN ('，', '、') AS comma_end
FROM obs_blocks WHERE otext IS NOT NULL""")
def q_text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Normal forms, script share and sentence ends."""
    s = F.col("otext")
    return table(spark, d, "obs_blocks").where(s.isNotNull()).select(F.col("block_id").alias("id"), T.normalize_whitespace(s).alias("normal"), T.short_head(s, 12).alias("head"), T.significant(s).alias("sig"), T.cjk_only(s).alias("cjk"), _r(T.cjk_fraction(s)).alias("cjk_fraction"), T.ends_sentence(s).alias("sentence_end"), T.ends_comma(s).alias("comma_end"))


@query(f"""
WITH x AS (SELECT freeze_id AS id, {_sig('heldtext')} AS a, {_sig('freshtext')} AS b FROM freezes WHERE heldtext IS NOT NULL AND freshtext IS NOT NULL),
y AS (SELECT id, a, b, {_lev('a', 'b')} AS lev, {_jac('a', 'b')} AS jac FROM x)
SELECT id, round(lev, 6) AS lev, round(jac, 6) AS jac, (length(a) > 0 AND length(b) > 0 AND (lev >= 0.70 OR jac >= 0.80)) AS similar FROM y""")
def q_text_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Both scores and the match test of held and fresh texts."""
    rows = table(spark, d, "freezes").where("heldtext is not null and freshtext is not null").select(F.col("freeze_id").alias("id"), T.significant(F.col("heldtext")).alias("a"), T.significant(F.col("freshtext")).alias("b"))
    lev, jac = T.levenshtein_ratio(F.col("a"), F.col("b")), T.jaccard(T.char_set(F.col("a")), T.char_set(F.col("b")))
    rows = rows.withColumn("lev", lev).withColumn("jac", jac)
    return rows.select("id", _r("lev").alias("lev"), _r("jac").alias("jac"), T.text_similar(F.col("lev"), F.col("jac"), F.col("a"), F.col("b")).alias("similar"))


@query(f"""
WITH x AS (SELECT freeze_id AS id, {_sig('heldtext')} AS w, {_sig('freshtext')} AS f FROM freezes WHERE heldtext IS NOT NULL AND freshtext IS NOT NULL),
y AS (SELECT id, w, f, unnest(CASE WHEN length(f) >= 4 AND length(f) <= length(w) THEN range(1, length(w) - length(f) + 2) ELSE [NULL] END) AS i FROM x),
z AS (SELECT id, f, substr(w, i, length(f)) AS piece FROM y)
SELECT id, round(max(CASE WHEN piece IS NULL THEN 0.0 ELSE 1.0 - ({_dist('f', 'piece')})::DOUBLE / length(f) END), 6) AS score FROM z GROUP BY id""")
def q_best_window(spark: SparkSession, d: str) -> DataFrame:
    """Best window of the held text for the whole fresh one."""
    rows = table(spark, d, "freezes").where("heldtext is not null and freshtext is not null")
    score = T.best_window(T.significant(F.col("freshtext")), T.significant(F.col("heldtext")))
    return rows.select(F.col("freeze_id").alias("id"), _r(score).alias("score"))


@query()
def q_containment(spark: SparkSession, d: str) -> DataFrame:
    """Longest common subsequence of raw texts over the inner length."""
    rows = table(spark, d, "freezes").where("heldtext is not null and freshtext is not null")
    return rows.select(F.col("freeze_id").alias("id"), _r(T.containment_ratio("freshtext", "heldtext")).alias("ratio"))


@query(f"""
WITH x AS (SELECT block_id AS id, otext AS s, rect[3] - rect[1] AS w, rect[4] - rect[2] AS h, length(otext) AS n,
  length(regexp_replace(otext, '[^{CJK}]', '', 'g'))::DOUBLE / greatest(length(otext), 1) AS cjk FROM obs_blocks WHERE otext IS NOT NULL),
y AS (SELECT *, list_max(list_transform(list_distinct(list_transform(range(1, n + 1), lambda i: substr(s, i, 1))), lambda c: n - length(replace(s, c, ''))))::DOUBLE / greatest(n, 1) AS dom FROM x)
SELECT id, round(CASE WHEN n = 0 THEN 0.3 ELSE 0.5 * (0.5 + 0.4 * cjk) + 0.3 * (CASE WHEN n <= 2 THEN 0.5 WHEN dom > 0.6 THEN 0.5 + 0.5 * (1 - dom) ELSE 1 END)
  + 0.2 * (CASE WHEN w / nullif(h * n, 0) > 3 THEN 0.6 WHEN w / nullif(h * n, 0) > 2 THEN 0.8 ELSE 1 END) END, 6) AS score FROM y""")
def q_text_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Heuristic confidence of a text and its box."""
    box = G.Box.of(F.col("rect"))
    rows = table(spark, d, "obs_blocks").where("otext is not null")
    return rows.select(F.col("block_id").alias("id"), _r(conf.raw_text_confidence(F.col("otext"), box.width, box.height)).alias("score"))


@query("""
SELECT session_id, cap, round(sum(tconf * length(otext)) FILTER (tconf IS NOT NULL) / nullif(sum(length(otext)) FILTER (tconf IS NOT NULL), 0), 6) AS tconf
FROM obs_blocks WHERE otext IS NOT NULL GROUP BY session_id, cap""")
def q_group_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of a group of lines, weighted by length."""
    rows = table(spark, d, "obs_blocks").where("otext is not null")
    return rows.groupBy("session_id", "cap").agg(_r(conf.weighted_text_confidence(F.col("tconf"), F.col("otext"))).alias("tconf"))


@query("""
WITH x AS (SELECT merge_id AS id, epoch_ms(recv_at) - ts AS age, CASE WHEN dx IS NULL OR dy IS NULL OR isnan(dx) OR isnan(dy) THEN NULL ELSE sqrt(dx * dx + dy * dy) END AS delta FROM merges),
y AS (SELECT id, delta, CASE WHEN age < 200 THEN 1.0 WHEN age > 2000 THEN 0.3 ELSE 1.0 - (age - 200) / 1800.0::DOUBLE * 0.7 END AS fresh,
  CASE WHEN delta IS NULL THEN 0.5 WHEN delta <= 5 THEN 1.0 WHEN delta >= 30 THEN 0.3 ELSE 1.0 - (delta - 5) / 25.0 * 0.7 END AS stable FROM x)
SELECT id, round(fresh, 6) AS fresh, round(stable, 6) AS stable, round(least(greatest(0.5 * fresh + 0.5 * stable, 0), 1), 6) AS pconf FROM y""")
def q_capture_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Freshness by age, stability by movement, at a height of 24."""
    rows = table(spark, d, "merges")
    age = F.expr("timestampdiff(MILLISECOND, timestamp_millis(ts), recv_at)")
    usable = F.col("dx").isNotNull() & F.col("dy").isNotNull() & ~F.isnan("dx") & ~F.isnan("dy")
    delta = F.when(usable, G.distance(F.col("dx"), F.col("dy")))
    fresh, stable = conf.freshness(age), conf.stability(delta, F.lit(24.0))
    return rows.select(F.col("merge_id").alias("id"), _r(fresh).alias("fresh"), _r(stable).alias("stable"), _r(conf.position_confidence(fresh, stable)).alias("pconf"))


@query("""
WITH x AS (SELECT block_id AS id, otext AS s, hex(encode(otext)) AS h FROM obs_blocks WHERE otext IS NOT NULL)
SELECT id, lower(printf('%016x', list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, i * 2 + 1, 2))::INT::UHUGEINT)),
  lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)) AS fnv, min(id) OVER (PARTITION BY s) AS same_text FROM x""")
def q_text_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Byte hash of every text, and the first row with an equal stable hash."""
    rows = table(spark, d, "obs_blocks").where("otext is not null").select(F.col("block_id").alias("id"), "otext", T.text_hash(F.col("otext")).alias("h"))
    first = rows.groupBy("h").agg(F.min("id").alias("same_text"))
    return rows.join(first, "h").select("id", T.fnv1a64_hex("otext").alias("fnv"), "same_text")


@query("""
SELECT session_id, CASE WHEN len(bk) = 2 AND bk[1] > 0 AND bk[2] > 0 THEN bk[1] END AS bucket_x, CASE WHEN len(bk) = 2 AND bk[1] > 0 AND bk[2] > 0 THEN bk[2] END AS bucket_y,
  CASE WHEN vp[1] >= 0 THEN round(vp[1], 2) END AS width, CASE WHEN vp[1] >= 0 THEN round(vp[2], 2) END AS height FROM sessions""")
def q_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Number pairs of the sessions, and viewports written and read as text."""
    bk = captures.pair(F.col("bk"))
    text = F.when(F.col("vp").isNotNull(), F.concat(F.get("vp", F.lit(0)).cast("decimal(18,2)").cast("string"), F.lit("x"), F.get("vp", F.lit(1)).cast("decimal(18,2)").cast("string")))
    view = captures.viewport_text(text)
    return table(spark, d, "sessions").select("session_id", F.get(bk, F.lit(0)).alias("bucket_x"), F.get(bk, F.lit(1)).alias("bucket_y"), F.get(view, F.lit(0)).alias("width"), F.get(view, F.lit(1)).alias("height"))


# --- coordinates and keys ---------------------------------------------------------


@query(BASE + f"""
, w AS (SELECT *, {_weight()} AS weight, floor(t / 500)::INT AS region FROM obs),
k AS (SELECT *, CASE WHEN weight >= 30 THEN 'unknown:0' WHEN weight = 20 AND kind = 'inner' THEN CASE WHEN cid IS NULL THEN 'unknown:0' ELSE 'ic:' || cid || ':' || region END ELSE 'normal:' || region END AS skey FROM w)
SELECT id, weight, skey, coalesce(try_cast(list_last(string_split(skey, ':')) AS INT), 0) AS region_index,
  (weight >= 30 OR (weight = 20 AND (hz >= 0 OR cid IS NULL))) AS excluded FROM k""")
def q_space_keys(spark: SparkSession, d: str) -> DataFrame:
    """Hierarchy weight, drift namespace, its region, and what drift leaves out."""
    rows = _obs(spark, d)
    return rows.select("id", "weight", "skey", C.region_index(F.col("skey")).alias("region_index"), C.excluded_from_drift(F.col("weight"), F.col("hz"), F.col("cid")).alias("excluded"))


def _key_sql(dx: str = "0", dy: str = "0") -> str:
    return f"""CASE WHEN kind = 'viewport' THEN 'vr:' || CASE WHEN length(cjk) >= 3 THEN substr(cjk, 1, 20) ELSE substr(plain, 1, 30) END
  ELSE CASE WHEN kind = 'inner' THEN 'ic:' ELSE '' END || CASE WHEN hz >= 0 THEN 'hz' || hz || ':' ELSE '' END || (round(l / 200)::BIGINT + {dx}) || ':' ||
  (round((t - CASE WHEN kind = 'inner' THEN inner_top ELSE 0 END) / 200)::BIGINT + {dy}) || ':s10:' || plain END"""


_KEYED = f"""

, placed AS (SELECT id, kind, hz, l, t, inner_top, text FROM obs UNION ALL SELECT -id, kind, hz, l, t, inner_top, text FROM trk),
named AS (SELECT *, {_norm('text')} AS plain, regexp_replace(text, '[^{CJK}]', '', 'g') AS cjk FROM placed)
"""


def _both(spark: SparkSession, d: str) -> DataFrame:
    cols = ["id", "kind", "hz", "rect", "inner_top", "text"]
    pick = lambda x: x.withColumn("rect", F.array("l", "t", "r", "b")).select(*cols)
    return pick(_obs(spark, d)).unionByName(pick(_trk(spark, d).withColumn("id", -F.col("id"))))


_KEY_COLUMNS = ("kind", "hz", "rect", "inner_top", "text")


@query(BASE + _KEYED + f"SELECT id, {_key_sql()} AS key FROM named")
def q_block_keys(spark: SparkSession, d: str) -> DataFrame:
    """Dedup key of observations and (negative ids) tracks."""
    return _both(spark, d).select("id", C.block_key(*map(F.col, _KEY_COLUMNS)).alias("key"))


@query(BASE + _KEYED + f"""
SELECT id, {_key_sql('dx', 'dy')} AS key FROM named, (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy)
WHERE kind <> 'viewport' AND NOT (dx = 0 AND dy = 0)""")
def q_neighbor_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the eight cells around."""
    return _both(spark, d).select("id", F.explode(C.neighbor_keys(*map(F.col, _KEY_COLUMNS))).alias("key"))


@query(f"""
SELECT block_id AS id, CASE WHEN pconf IS NULL OR isnan(pconf) OR pconf < 0 OR pconf > 1 THEN 'pconf_invalid' WHEN tconf IS NULL OR isnan(tconf) OR tconf < 0 OR tconf > 1 THEN 'tconf_invalid'
  WHEN otext IS NULL OR regexp_replace(otext, '{SPACES}', '', 'g') = '' THEN 'noise' WHEN NOT isc AND cid IS NOT NULL THEN 'container_without_inner'
  WHEN hsc <> (CASE WHEN hsc THEN coalesce(sc[3]::INT, -1) ELSE -1 END >= 0) THEN 'carousel_flag_mismatch' END AS fault
FROM obs_blocks WHERE fault IS NOT NULL""")
def q_faults(spark: SparkSession, d: str) -> DataFrame:
    """Observations that may not enter the engine, with the reason."""
    return blocks.faults(table(spark, d, "obs_blocks"))


@query("""
SELECT session_id, least(greatest(0.18 * vp[1], 80), 220) AS bucket_width, least(greatest(0.15 * vp[2], 80), 220) AS bucket_height FROM sessions WHERE vp IS NOT NULL""")
def q_bucket_sizes(spark: SparkSession, d: str) -> DataFrame:
    """J2d: grid cells of each session's viewport."""
    width, height = C.bucket_sizes(F.get("vp", F.lit(0)), F.get("vp", F.lit(1)))
    return table(spark, d, "sessions").where("vp is not null").select("session_id", width.alias("bucket_width"), height.alias("bucket_height"))


@query("""
SELECT session_id, cap, capture_id, last_value(eng IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY cap, capture_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eng FROM captures""")
def q_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """O3: the latest setting that was given applies until the next."""
    rows = table(spark, d, "captures").select("session_id", "cap", "capture_id", "eng")
    return S.carried(rows, ["session_id"], ["cap", "capture_id"], "eng")


# --- spatial ----------------------------------------------------------------------


@query(BASE + """
SELECT id, CASE WHEN kind = 'viewport' THEN 'vr' ELSE 'abs' END AS layer, round((l + (r - l) / 2) / 200)::BIGINT AS x, round((t + (b - t) / 2) / 200)::BIGINT AS y FROM obs
UNION ALL SELECT id, 'ic', round((l + (r - l) / 2) / 200)::BIGINT, round((t + (b - t) / 2 - inner_top) / 200)::BIGINT FROM obs WHERE kind = 'inner'""")
def q_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cells every observation is stored in."""
    return spatial.cells(_obs(spark, d)).select("id", "cell.layer", "cell.x", "cell.y")


@query(BASE + f"SELECT f.id, count(*) AS candidates, sum(c.id)::BIGINT AS id_sum FROM obs f JOIN trk c ON f.session_id = c.session_id AND {_near('f', 'c')} GROUP BY f.id")
def q_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Tracks in the nine cells around each observation."""
    slim = lambda x: x.select("session_id", "id", "kind", "inner_top", *"ltrb")
    pairs = spatial.candidates(slim(_obs(spark, d)), slim(_trk(spark, d)), ["session_id"])
    return pairs.groupBy(F.col("f_id").alias("id")).agg(F.count(F.lit(1)).alias("candidates"), F.sum("c_id").alias("id_sum"))


@query(BASE + """
SELECT h.id, count(*) AS rows, sum(p.id)::BIGINT AS id_sum FROM trk h JOIN trk p ON h.session_id = p.session_id AND p.kind <> 'viewport'
AND round((p.l + (p.r - p.l) / 2) / 200) BETWEEN floor(h.l / 200) - 1 AND ceil(h.r / 200) + 1 AND round((p.t + (p.b - p.t) / 2) / 200) BETWEEN floor(h.t / 200) - 1 AND ceil(h.b / 200) + 1
GROUP BY h.id""")
def q_region(spark: SparkSession, d: str) -> DataFrame:
    """Page-layer tracks of the cells a rectangle covers."""
    slim = _trk(spark, d).select("session_id", "id", "kind", "inner_top", *"ltrb")
    return spatial.region(slim, slim, ["session_id"]).groupBy(F.col("h_id").alias("id")).agg(F.count(F.lit(1)).alias("rows"), F.sum("p_id").alias("id_sum"))


_PAIRS = f"""
, o AS (SELECT *, {_weight()} AS weight, length(regexp_replace(text, '[^{CJK}]', '', 'g'))::DOUBLE / greatest(length(text), 1) AS cjk FROM obs),
p AS (SELECT f.session_id, f.cap, f.id AS f_id, c.id AS c_id, {_common('f', 'c')} AS common, {_area('f')} AS fa, {_area('c')} AS ca, f.weight AS fw, c.weight AS cw,
  0.4 * f.pconf + 0.6 * f.tconf AS fq, 0.4 * c.pconf + 0.6 * c.tconf AS cq, f.text = c.text AS same_text,
  CASE WHEN f.cjk >= 0.6 THEN 0.35 WHEN f.cjk < 0.3 AND length(f.text) <= 8 THEN 0.65 ELSE 0.5 END AS threshold
  FROM o f JOIN o c ON f.session_id = c.session_id AND f.cap = c.cap AND f.id < c.id WHERE {_common('f', 'c')} > 0)
"""


@query(BASE + _PAIRS + """
SELECT f_id, c_id, round(least(greatest(common / least(fa, ca), 0), 1), 6) AS ratio, same_text, CASE WHEN common / least(fa, ca) >= 0.9 AND common / greatest(fa, ca) < 0.5 THEN 'small-inside-large'
  WHEN common / least(fa, ca) >= 0.5 AND common / greatest(fa, ca) >= 0.5 THEN 'near-duplicate' ELSE 'partial' END AS shape FROM p""")
def q_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs of each capture and their shape."""
    pairs = overlap.overlapping_pairs(_obs(spark, d), ["session_id", "cap"])
    a, b = side("f_").area, side("c_").area
    return pairs.select("f_id", "c_id", _r(overlap.ratio("f_", "c_")).alias("ratio"), (F.col("f_text") == F.col("c_text")).alias("same_text"), overlap.shape(F.col("common"), a, b).alias("shape"))


@query(BASE + _PAIRS + """
SELECT f_id, c_id, round(fq, 6) AS quality, common / least(fa, ca) >= threshold AS overlaps, CASE WHEN fw > cw THEN 'evict' WHEN fw < cw THEN 'drop' WHEN fa > 0 AND fq >= cq AND ca > 3 * fa THEN 'evict'
  WHEN fq >= cq + CASE WHEN common / least(fa, ca) >= 0.70 THEN 0 ELSE 0.1 END THEN 'evict' ELSE 'keep' END AS outcome FROM p""")
def q_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Which of two overlapping blocks stays."""
    pairs = overlap.overlapping_pairs(_obs(spark, d), ["session_id", "cap"])
    a, b = side("f_").area, side("c_").area
    share = F.try_divide(F.col("common"), F.least(a, b))
    return pairs.select("f_id", "c_id", _r(overlap.quality(F.col("f_pconf"), F.col("f_tconf"))).alias("quality"), (share >= overlap.threshold_for(F.col("f_text"))).alias("overlaps"), overlap.resolve("f_", "c_", share).alias("outcome"))


# --- matching -----------------------------------------------------------------------


@query(BASE + _MATCHED + "SELECT session_id, f_id, c_id, round(lev, 6) AS lev, round(jac, 6) AS jac, round(dist, 6) AS dist FROM best")
def q_primary_match(spark: SparkSession, d: str) -> DataFrame:
    """The best track for every observation."""
    hits = match.primary_match(_obs(spark, d), _trk(spark, d), ["session_id"])
    return hits.select("session_id", "f_id", "c_id", _r("lev").alias("lev"), _r("jac").alias("jac"), _r("dist").alias("dist"))


@query(BASE + f"""
, pairs AS (SELECT f.session_id, c.obs, {_lev('f.sig', 'c.sig')} AS lev, {_jac('f.sig', 'c.sig')} AS jac, least(greatest(({_common('f', 'c')}) / least({_area('f')}, {_area('c')}), 0), 1) AS ratio, length(f.sig) AS n, length(c.sig) AS m
  FROM obs f JOIN trk c ON f.session_id = c.session_id AND (f.kind = 'viewport') = (c.kind = 'viewport') AND {_near('f', 'c')}),
rest AS (SELECT session_id, CASE WHEN obs < 4 THEN 'floor' WHEN ratio < 0.8 THEN 'spatial' WHEN lev < 0.5 AND jac < 0.6 THEN 'text' ELSE 'identified' END AS stage FROM pairs WHERE NOT (n > 0 AND m > 0 AND (lev >= 0.70 OR jac >= 0.80)))
SELECT session_id, count(*) AS considered, count(*) FILTER (stage = 'floor') AS rejected_floor, count(*) FILTER (stage = 'spatial') AS rejected_spatial, count(*) FILTER (stage = 'text') AS rejected_text, count(*) FILTER (stage = 'identified') AS identified
FROM rest GROUP BY session_id""")
def q_band_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the relaxed match."""
    return match.band_funnel(_obs(spark, d), _trk(spark, d), ["session_id"])


def _fragments(trk: DataFrame) -> DataFrame:
    """The left half of every track as a fresh row of its own."""
    half = trk.withColumn("r", F.col("l") + (F.col("r") - F.col("l")) / 2).withColumn("text", F.substring("text", 1, F.floor(F.length("text") / 2).cast("int")))
    return blocks.enrich(half.drop("sig", "chars", "weight", "skey"))


@query(BASE + f"""
, frag AS (SELECT session_id, -id AS id, kind, hz, l, t, l + (r - l) / 2 AS r, b, {_sig('substr(text, 1, length(text) // 2)')} AS sig FROM trk WHERE kind <> 'viewport'
  UNION ALL SELECT session_id, id, kind, hz, l, t, r, b, sig FROM obs WHERE kind <> 'viewport'),
pairs AS (SELECT f.session_id, f.id AS f_id, c.id AS c_id, f.sig AS f, c.sig AS w, round({_area('c')}, 6) AS area
  FROM frag f JOIN trk c ON f.session_id = c.session_id AND c.kind <> 'viewport' AND NOT c.provisional AND (f.hz < 0 OR c.hz < 0 OR f.hz = c.hz) AND {_area('f')} > 0 AND {_area('c')} > {_area('f')} AND ({_common('f', 'c')}) / {_area('f')} >= 0.8
  WHERE length(f.sig) >= 4 AND length(f.sig) <= length(c.sig)),
spots AS (SELECT *, unnest(range(1, length(w) - length(f) + 2)) AS i FROM pairs),
pieces AS (SELECT session_id, f_id, c_id, area, f, substr(w, i, length(f)) AS piece FROM spots),
scored AS (SELECT session_id, f_id, c_id, area, max(1.0 - ({_dist('f', 'piece')})::DOUBLE / length(f)) AS score FROM pieces GROUP BY ALL)
SELECT f_id, c_id, round(score, 6) AS score FROM scored WHERE score >= 0.70 QUALIFY row_number() OVER (PARTITION BY f_id ORDER BY area, c_id) = 1""")
def q_nested_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The smallest host of each observation and (negative ids) half line."""
    trk = _trk(spark, d)
    halves = _fragments(trk).withColumn("id", -F.col("id"))
    return match.nested_hosts(_obs(spark, d).unionByName(halves), trk, ["session_id"]).select("f_id", "c_id", _r("window").alias("score"))


@query(BASE + """
, inc AS (SELECT new_id AS id, session_id, cap, otext AS text, rect[1] AS l, rect[2] AS t, rect[3] AS r, rect[4] AS b FROM incoming_blocks WHERE otext IS NOT NULL)
SELECT f.id, arg_max(c.id, (c.cap, -c.id)) AS stamp_id, f.cap - max(c.cap) AS latency FROM inc f LEFT JOIN obs c ON f.session_id = c.session_id AND f.text = c.text AND c.cap <= f.cap
AND sqrt(((f.l + (f.r - f.l) / 2) - (c.l + (c.r - c.l) / 2)) ** 2 + ((f.t + (f.b - f.t) / 2) - (c.t + (c.b - c.t) / 2)) ** 2) <= 200 GROUP BY f.id, f.cap""")
def q_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The latest earlier sighting of the same text nearby."""
    rect = [F.get("rect", F.lit(i)).alias(n) for i, n in enumerate("ltrb")]
    new = table(spark, d, "incoming_blocks").where("otext is not null").select("session_id", "cap", F.col("new_id").alias("id"), F.col("otext").alias("text"), *rect)
    return match.as_of(new, _obs(spark, d), ["session_id"]).select("id", "stamp_id", "latency")


# --- contradictions, retention, census --------------------------------------------------


def _tall(trk: DataFrame) -> DataFrame:
    """Neighbouring tracks of a column read as one tall block, keyed by the upper one."""
    w = Window.partitionBy("session_id", "kind", "hz", "l").orderBy("t", "id")
    nxt = trk.withColumn("t2", F.lead("text").over(w)).withColumn("b2", F.lead("b").over(w)).withColumn("r2", F.lead("r").over(w))
    both = nxt.where("t2 is not null and b2 - t < 90").select(*[c for c in trk.columns if c not in ("text", "r", "b", "sig", "chars", "weight", "skey", "obs")], F.concat_ws(" ", "text", "t2").alias("text"), F.greatest("r", "r2").alias("r"), F.col("b2").alias("b"), F.lit(3).alias("obs"))
    return blocks.enrich(both)


_TALL = f"""
, nxt AS (SELECT *, lead(text) OVER w AS text2, lead(b) OVER w AS b2, lead(r) OVER w AS r2 FROM trk WINDOW w AS (PARTITION BY session_id, kind, hz, l ORDER BY t, id)),
tall AS (SELECT session_id, id, kind, hz, l, t, greatest(r, r2) AS r, b2 AS b, text || ' ' || text2 AS text, {_sig("text || ' ' || text2")} AS sig FROM nxt WHERE text2 IS NOT NULL AND b2 - t < 90)
"""


@query(BASE + _TALL + f"""
, parts AS (SELECT h.id, h.sig, p.sig AS psig, p.t, p.id AS pid FROM tall h JOIN trk p ON h.session_id = p.session_id AND h.kind <> 'viewport' AND p.kind <> 'viewport' AND (p.b - p.t) < 0.7 * (h.b - h.t) AND ({_common('h', 'p')}) / {_area('h')} >= 0.3),
g AS (SELECT id, sig, string_agg(psig, '' ORDER BY t, pid) AS joined, count(*) AS n FROM parts GROUP BY id, sig HAVING count(*) >= 2),
s AS (SELECT id, n, {_lev('sig', 'joined')} AS lev FROM g)
SELECT id, n AS pieces, round(lev, 6) AS lev FROM s WHERE lev >= 0.60""")
def q_grouping_contradiction(spark: SparkSession, d: str) -> DataFrame:
    """Tall tracks whose text now appears as several lines."""
    trk = _trk(spark, d)
    found = lifecycle.grouping_contradictions(_tall(trk), trk, ["session_id"])
    return found.select("id", F.size("evidence").cast("long").alias("pieces"), _r("lev").alias("lev"))


@query((BASE + _TALL).replace("WITH obs", "WITH RECURSIVE obs", 1) + f"""
, parts AS (SELECT h.session_id, h.id, h.sig, p.sig AS psig, p.t, p.id AS pid FROM tall h JOIN trk p ON h.session_id = p.session_id AND h.kind <> 'viewport' AND p.kind <> 'viewport' AND p.obs >= 3 AND (p.b - p.t) < 0.7 * (h.b - h.t) AND ({_common('h', 'p')}) / {_area('p')} >= 0.8),
cand AS MATERIALIZED (SELECT session_id, id, sig, list({{'pid': pid, 'psig': psig}} ORDER BY t, pid) AS ps, row_number() OVER (PARTITION BY session_id ORDER BY id) AS k FROM parts GROUP BY session_id, id, sig),
walk(session_id, k, used, id, n, lev) AS (
  SELECT DISTINCT session_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT, 0::BIGINT, 0::DOUBLE FROM cand
  UNION ALL
  SELECT session_id, k, CASE WHEN n >= 2 AND lev >= 0.60 THEN list_concat(used, ids) ELSE used END, id, n, lev FROM (
    SELECT session_id, k, used, id, ids, n, {_lev('sig', 'joined')} AS lev FROM (
      SELECT session_id, k, used, id, sig, list_transform(free, lambda q: q.pid) AS ids, len(free) AS n, array_to_string(list_transform(free, lambda q: q.psig), '') AS joined FROM (
        SELECT c.session_id, c.k, w.used, c.id, c.sig, list_filter(c.ps, lambda q: NOT list_contains(w.used, q.pid)) AS free FROM walk w JOIN cand c ON c.session_id = w.session_id AND c.k = w.k + 1))))
SELECT id, n AS pieces, round(lev, 6) AS lev FROM walk WHERE n >= 2 AND lev >= 0.60""")
def q_splitting_contradiction(spark: SparkSession, d: str) -> DataFrame:
    """Fresh tall blocks that swallow several tracks, evidence consumed in fresh order."""
    trk = _trk(spark, d)
    found = lifecycle.splitting_contradictions(_tall(trk), trk, ["session_id"])
    return found.select("id", F.size("evidence").cast("long").alias("pieces"), _r("lev").alias("lev"))


def _held(spark: SparkSession, d: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fresh, tracked, matches) of every capture against the one before it."""
    fresh, old = match.consecutive(_obs(spark, d))
    return fresh, old, match.primary_match(fresh, old, ["session_id", "cap"], carry)


_COVERED = f"""
, o AS (SELECT *, length(regexp_replace(text, '[^{CJK}]', '', 'g'))::DOUBLE / greatest(length(text), 1) AS cjk FROM obs),
covered AS (SELECT DISTINCT c.id FROM o f JOIN o c ON f.session_id = c.session_id AND c.cap = f.cap - 1 AND (f.hz < 0 OR c.hz < 0 OR f.hz = c.hz) AND {_area('c')} > 0
  AND ({_common('f', 'c')}) / {_area('c')} >= greatest(0.5, CASE WHEN c.cjk >= 0.6 THEN 0.35 WHEN c.cjk < 0.3 AND length(c.text) <= 8 THEN 0.65 ELSE 0.5 END))
"""


@query(BASE + _COVERED + "SELECT id FROM covered")
def q_supersession(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a capture covered by a row of the next one."""
    fresh, old = match.consecutive(_obs(spark, d))
    return lifecycle.superseded(old, fresh, ["session_id", "cap"]).select(F.col("c_id").alias("id"))


@query(BASE + _STEP + _COVERED + """
SELECT c.id, CASE WHEN c.id IN (SELECT id FROM covered) THEN 'dropped' ELSE 'retained' END AS fate FROM obs c WHERE c.id NOT IN (SELECT c_id FROM held)""")
def q_retention(spark: SparkSession, d: str) -> DataFrame:
    """J16, U2, ST8: fate of rows the next capture does not match, with one missed frame."""
    fresh, old, held = _held(spark, d)
    scope = ["session_id", "cap"]
    return lifecycle.retention(old, held, lifecycle.superseded(old, fresh, scope), scope, 1).select("id", "fate")


@query(BASE + _STEP + """
, n AS (SELECT session_id, cap, count(*) AS fresh FROM obs GROUP BY ALL), m AS (SELECT session_id, cap, count(*) AS merged, count(DISTINCT c_id) AS held FROM held GROUP BY ALL)
SELECT n.session_id, n.cap, n.fresh, coalesce(merged, 0) AS merged, n.fresh - coalesce(merged, 0) AS admitted, coalesce(p.fresh, 0) - coalesce(held, 0) AS unmatched, round((n.fresh - coalesce(merged, 0))::DOUBLE / n.fresh, 6) AS admitted_share
FROM n LEFT JOIN m USING (session_id, cap) LEFT JOIN n p ON p.session_id = n.session_id AND p.cap = n.cap - 1""")
def q_turnover(spark: SparkSession, d: str) -> DataFrame:
    """Census of every capture against the one before it."""
    fresh, old, held = _held(spark, d)
    out = lifecycle.census(fresh, old, held, ["session_id", "cap"])
    return out.select("session_id", "cap", "fresh", "merged", "admitted", "unmatched", _r("admitted_share").alias("admitted_share"))


@query(BASE + _STEP + """
SELECT f_id, c_id, round(fl - cl, 6) AS dx, round(ft - ct, 6) AS dy, sqrt((fl - cl) ** 2 + (ft - ct) ** 2) <= 3 * (cb - ct) AS agreeing FROM held WHERE NOT c_prov AND f_kind <> 'viewport' AND f_hz < 0 AND c_hz < 0""")
def q_shift_votes(spark: SparkSession, d: str) -> DataFrame:
    """P7-P9, SH1: displacement of each eligible pair, moved or agreeing."""
    _, _, held = _held(spark, d, ("kind", "hz", "provisional", "l", "t", "b"))
    ok = held.where(~F.col("c_provisional") & merge.step_eligible(F.col("f_kind"), F.col("f_hz"), F.col("c_hz")))
    dx, dy = F.col("f_l") - F.col("c_l"), F.col("f_t") - F.col("c_t")
    return ok.select("f_id", "c_id", _r(dx).alias("dx"), _r(dy).alias("dy"), (G.distance(dx, dy) <= G.agreement_scale(F.col("c_b") - F.col("c_t"))).alias("agreeing"))


_FIT = """
, p AS (SELECT session_id, cap, cl + (cr - cl) / 2 AS x0, ct + (cb - ct) / 2 AS y0, fl + (fr - fl) / 2 AS x1, ft + (fb - ft) / 2 AS y1 FROM held WHERE NOT c_prov AND f_kind <> 'viewport' AND f_hz < 0 AND c_hz < 0),
m1 AS (SELECT session_id, cap, count(*) AS n, avg(x0) AS mx0, avg(y0) AS my0, avg(x1) AS mx1, avg(y1) AS my1 FROM p GROUP BY ALL HAVING count(*) >= 3),
s1 AS (SELECT session_id, cap, any_value(mx0) AS mx0, any_value(my0) AS my0, any_value(mx1) AS mx1, any_value(my1) AS my1, sum((x0 - mx0) ** 2 + (y0 - my0) ** 2) AS sxx, sum((x0 - mx0) * (x1 - mx1) + (y0 - my0) * (y1 - my1)) AS sxy FROM p JOIN m1 USING (session_id, cap) GROUP BY ALL),
f1 AS (SELECT *, sxy / sxx AS s FROM s1 WHERE sxx > 0 AND sxy / sxx > 0),
r1 AS (SELECT p.*, sqrt((s * x0 + (mx1 - s * mx0) - x1) ** 2 + (s * y0 + (my1 - s * my0) - y1) ** 2) AS off FROM p JOIN f1 USING (session_id, cap)),
k1 AS (SELECT *, off > 3 * median(off) OVER (PARTITION BY session_id, cap) AS cut FROM r1),
c1 AS (SELECT session_id, cap, count(*) FILTER (cut) AS rejected, count(*) FILTER (NOT cut) AS kept FROM k1 GROUP BY ALL),
p2 AS (SELECT k1.*, CASE WHEN rejected > 0 AND kept >= 3 THEN rejected ELSE 0 END AS rejected FROM k1 JOIN c1 USING (session_id, cap) WHERE NOT cut OR rejected = 0 OR kept < 3),
m2 AS (SELECT session_id, cap, count(*) AS n, any_value(rejected) AS rejected, avg(x0) AS mx0, avg(y0) AS my0, avg(x1) AS mx1, avg(y1) AS my1 FROM p2 GROUP BY ALL),
s2 AS (SELECT session_id, cap, any_value(n) AS n, any_value(m2.rejected) AS rejected, any_value(mx0) AS mx0, any_value(my0) AS my0, any_value(mx1) AS mx1, any_value(my1) AS my1, sum((x0 - mx0) ** 2 + (y0 - my0) ** 2) AS sxx, sum((x0 - mx0) * (x1 - mx1) + (y0 - my0) * (y1 - my1)) AS sxy FROM p2 JOIN m2 USING (session_id, cap) GROUP BY ALL)
SELECT session_id, cap, n AS pairs, rejected, round(sxy / sxx, 6) AS scale, round(mx1 - sxy / sxx * mx0, 4) AS tx, round(my1 - sxy / sxx * my0, 4) AS ty, round(sqrt(sxx / n), 4) AS span FROM s2 WHERE sxx > 0 AND sxy / sxx > 0"""


def _fit(spark: SparkSession, d: str) -> DataFrame:
    _, _, held = _held(spark, d, ("kind", "hz", "provisional", "l", "t", "r", "b"))
    ok = held.where(~F.col("c_provisional") & merge.step_eligible(F.col("f_kind"), F.col("f_hz"), F.col("c_hz")))
    a, b = side("c_"), side("f_")
    pairs = ok.select("session_id", "cap", a.center_x.alias("x0"), a.center_y.alias("y0"), b.center_x.alias("x1"), b.center_y.alias("y1"))
    return lifecycle.fit_transform(pairs, ["session_id", "cap"])


@query(BASE + _STEP + _FIT)
def q_transform_fit(spark: SparkSession, d: str) -> DataFrame:
    """Scale and shift between consecutive captures."""
    return _fit(spark, d).select("session_id", "cap", "pairs", "rejected", _r("scale").alias("scale"), _r("tx", 4).alias("tx"), _r("ty", 4).alias("ty"), _r("span", 4).alias("span"))


_QUALITY = """
, fitted AS MATERIALIZED (SELECT session_id, cap, n AS pairs, sxy / sxx AS scale, mx1 - sxy / sxx * mx0 AS tx, my1 - sxy / sxx * my0 AS ty FROM s2 WHERE sxx > 0 AND sxy / sxx > 0),
e AS (SELECT session_id, cap, sqrt(avg((scale * x0 + tx - x1) ** 2 + (scale * y0 + ty - y1) ** 2)) AS residual, max(x0) - min(x0) AS ex, max(y0) - min(y0) AS ey FROM p2 JOIN fitted USING (session_id, cap) GROUP BY ALL),
along AS (SELECT session_id, cap, greatest(ex, ey) AS extent, CASE WHEN ex >= ey THEN x0 ELSE y0 END AS v FROM p2 JOIN e USING (session_id, cap)),
gaps AS (SELECT session_id, cap, extent, v - lag(v) OVER (PARTITION BY session_id, cap ORDER BY v) AS gap FROM along),
g AS (SELECT session_id, cap, CASE WHEN any_value(extent) > 0 THEN coalesce(max(gap), 0) / any_value(extent) ELSE 0 END AS largest_gap FROM gaps GROUP BY ALL),
quality AS (SELECT session_id, cap, pairs, scale, tx, ty, residual, largest_gap FROM fitted JOIN e USING (session_id, cap) JOIN g USING (session_id, cap))
"""
_FITTED = BASE + _STEP + _FIT.rpartition("SELECT session_id, cap, n AS pairs")[0] + _QUALITY


@query(_FITTED + """
SELECT session_id, cap, round(residual, 4) AS residual, round(largest_gap, 4) AS largest_gap, CASE WHEN abs(1 - scale) >= 1e-9 THEN round(tx / (1 - scale), 2) END AS fixed_x, CASE WHEN abs(1 - scale) >= 1e-9 THEN round(ty / (1 - scale), 2) END AS fixed_y FROM quality""")
def q_transform_quality(spark: SparkSession, d: str) -> DataFrame:
    """Residual, largest gap and fixed point of each fit."""
    return _fit(spark, d).select("session_id", "cap", _r("residual", 4).alias("residual"), _r("largest_gap", 4).alias("largest_gap"), _r("fixed_x", 2).alias("fixed_x"), _r("fixed_y", 2).alias("fixed_y"))


@query(_FITTED + """
SELECT session_id, round(max(abs(scale - 1)), 6) AS peak, arg_min(cap, (-round(abs(scale - 1), 9), cap)) AS cap, count(*) AS captures FROM quality GROUP BY session_id""")
def q_transform_peak(spark: SparkSession, d: str) -> DataFrame:
    """The strongest scaling of every session and the first capture that has it."""
    off = F.abs(F.col("scale") - 1)
    best = _fit(spark, d).groupBy("session_id").agg(F.max(off).alias("peak"), F.max_by("cap", F.struct(F.round(off, 9), -F.col("cap"))).alias("cap"), F.count(F.lit(1)).alias("captures"))
    return best.select("session_id", _r("peak").alias("peak"), "cap", "captures")


@query(_FITTED + """
, grid AS (SELECT * FROM (VALUES (2.0), (5.0), (10.0), (20.0), (1e9)) AS a(max_residual), (VALUES (3), (6)) AS b(min_pairs), (VALUES (0.5), (1.0)) AS c(max_gap))
SELECT max_residual::DOUBLE AS max_residual, min_pairs, max_gap::DOUBLE AS max_gap, count(*) AS captures, round(max(abs(scale - 1)), 6) AS deviation FROM quality JOIN grid ON residual < max_residual AND pairs >= min_pairs AND largest_gap <= max_gap GROUP BY ALL""")
def q_zoom_margins(spark: SparkSession, d: str) -> DataFrame:
    """Largest deviation from scale 1 for a grid of residual, pair and gap limits."""
    fits = _fit(spark, d)
    grid = spark.createDataFrame([(r, p, g) for r in (2.0, 5.0, 10.0, 20.0, 1e9) for p in (3, 6) for g in (0.5, 1.0)], "max_residual double, min_pairs int, max_gap double")
    ok = fits.join(F.broadcast(grid), (F.col("residual") < F.col("max_residual")) & (F.col("pairs") >= F.col("min_pairs")) & (F.col("largest_gap") <= F.col("max_gap")))  # a fixed grid of twenty rows
    return ok.groupBy("max_residual", "min_pairs", "max_gap").agg(F.count(F.lit(1)).alias("captures"), _r(F.max(F.abs(F.col("scale") - 1))).alias("deviation"))


# --- merging ------------------------------------------------------------------------


_MERGED = f"""
, x AS (SELECT m.f_id, m.c_id, f.l AS fl, f.t AS ft, f.r AS fr, f.b AS fb, c.l AS cl, c.t AS ct, c.r AS cr, c.b AS cb, f.pconf AS fp, c.pconf AS cp, f.tconf AS fc, c.tconf AS cc, greatest(1, c.obs) AS n, f.text = c.text AS same, greatest(f.srcq, c.srcq) AS srcq,
  sqrt((f.l - c.l) ** 2 + (f.t - c.t) ** 2) AS residual FROM best m JOIN obs f ON m.f_id = f.id JOIN trk c ON m.c_id = c.id),
w AS (SELECT *, CASE WHEN cp * n + fp > 0 THEN fp / (cp * n + fp) ELSE 0.5 END AS w, CASE WHEN cc + fc > 0 THEN fc / (cc + fc) ELSE 0.5 END AS tw FROM x)
SELECT f_id, c_id, round(w, 6) AS weight, round(cl * (1 - w) + fl * w, 6) AS l, round(ct * (1 - w) + ft * w, 6) AS t, round(cr * (1 - w) + fr * w, 6) AS r, round(cb * (1 - w) + fb * w, 6) AS b,
  round((cp * n + least(greatest(1 - residual / (3 * (cb - ct)), 0), 1)) / (n + 1), 6) AS pconf, round(least(cp + fp, 1), 6) AS legacy_pconf, round(CASE WHEN same THEN least(greatest(cc * (1 - tw) + fc * tw, 0), 1) ELSE cc END, 6) AS tconf, srcq FROM w"""


@query(BASE + _MATCHED + _MERGED)
def q_merge(spark: SparkSession, d: str) -> DataFrame:
    """G8-G12, A14, A15, ST7: one merge of every observation into its track, no drift."""
    hits = match.primary_match(_obs(spark, d), _trk(spark, d), ["session_id"], ("text", "pconf", "tconf", "srcq", "obs", *"ltrb"))
    f, c = side("f_"), side("c_")
    box, pconf = merge.merged(f, c, F.col("f_pconf"), F.col("c_pconf"), F.col("c_obs"))
    w = merge.weight(F.col("f_pconf"), F.col("c_pconf"), F.col("c_obs"))
    tconf = merge.text_confidence(F.lit(False), F.col("f_text") == F.col("c_text"), F.lit(0.0), F.col("c_tconf"), F.col("f_tconf"))
    return hits.select("f_id", "c_id", _r(w).alias("weight"), *[_r(e).alias(n) for e, n in zip(box.edges, "ltrb")], _r(pconf).alias("pconf"), _r(merge.legacy_confidence(F.col("f_pconf"), F.col("c_pconf"))).alias("legacy_pconf"), _r(tconf).alias("tconf"), F.greatest("f_srcq", "c_srcq").alias("srcq"))


@query(BASE + _MATCHED + f"""
, v AS (SELECT m.c_id, {_weight('f.kind', 'f.hz')} AS weight, f.hz, f.id FROM best m JOIN obs f ON m.f_id = f.id),
cw AS (SELECT c_id, weight, count(*) AS n, min(id) AS since FROM v GROUP BY ALL), ch AS (SELECT c_id, hz, count(*) AS n, min(id) AS since FROM v GROUP BY ALL),
a AS (SELECT c_id, arg_max(weight, (n, -since)) AS weight, sum(n)::BIGINT AS votes FROM cw GROUP BY c_id), b AS (SELECT c_id, arg_max(hz, (n, -since)) AS hz, bool_or(hz >= 0) AS carousel FROM ch GROUP BY c_id)
SELECT c_id AS id, a.weight, votes, b.hz, carousel, a.weight <> {_weight('c.kind', 'c.hz')} AS reclassify FROM a JOIN b USING (c_id) JOIN trk c ON c.id = c_id""")
def q_class_votes(spark: SparkSession, d: str) -> DataFrame:
    """Class and carousel votes of every track."""
    hits = match.primary_match(_obs(spark, d), _trk(spark, d), ["session_id"], ("weight", "hz"))
    by = merge.winner(merge.histogram(hits, ["c_id"], "f_weight", "f_id"), ["c_id"]).select("c_id", F.col("winner").alias("weight"), "votes")
    lanes = merge.histogram(hits, ["c_id"], "f_hz", "f_id")
    lane = merge.winner(lanes, ["c_id"]).select("c_id", F.col("winner").alias("hz")).join(lanes.groupBy("c_id").agg(F.bool_or(F.col("vote") >= 0).alias("carousel")), "c_id")
    own = _trk(spark, d).select(F.col("id").alias("c_id"), F.col("weight").alias("own"))
    return by.join(lane, "c_id").join(own, "c_id").select(F.col("c_id").alias("id"), "weight", "votes", "hz", "carousel", (F.col("weight") != F.col("own")).alias("reclassify"))


@query(BASE + _MATCHED + """
, v AS (SELECT m.c_id, f.sig AS vote, f.text, f.tconf, f.id FROM best m JOIN obs f ON m.f_id = f.id),
s AS (SELECT c_id, vote, sum(tconf) AS score, max(tconf) AS best, arg_max(text, (tconf, -id)) AS spelling, min(id) AS since FROM v GROUP BY ALL)
SELECT c_id AS id, vote, round(score, 4) AS score, best, spelling FROM s QUALIFY row_number() OVER (PARTITION BY c_id ORDER BY round(score, 4) DESC, since) <= 5""")
def q_text_votes(spark: SparkSession, d: str) -> DataFrame:
    """The five best spellings of every track."""
    hits = match.primary_match(_obs(spark, d), _trk(spark, d), ["session_id"], ("sig", "text", "tconf"))
    votes = merge.text_votes(hits, ["c_id"], "f_sig", "f_text", "f_tconf", "f_id").withColumn("score", _r("score", 4))
    w = Window.partitionBy("c_id").orderBy(F.desc("score"), "since")
    return votes.withColumn("place", F.row_number().over(w)).where(F.col("place") <= merge.MAX_VOTES).select(F.col("c_id").alias("id"), F.col("f_sig").alias("vote"), "score", "best", "spelling")


# --- statistics ----------------------------------------------------------------------


_CLEAN = "m AS (SELECT session_id, dx FROM merges WHERE dx IS NOT NULL AND NOT isnan(dx))"
_HALF = "list_sort(list(dx))"


@query(f"""
WITH {_CLEAN}, g AS (SELECT session_id, list_sort(list(dx)) AS a, len(list(dx)) AS n, median(dx) AS med FROM m GROUP BY session_id),
d AS (SELECT session_id, a, n, med, list_aggregate(list_transform(a, lambda x: abs(x - med)), 'median') * 1.4826 AS mad, list_aggregate(a[1:n // 2], 'median') AS q1, list_aggregate(a[n - n // 2 + 1:n], 'median') AS q3, a[1] AS low, a[n] AS high FROM g),
e AS (SELECT *, CASE WHEN n >= 4 THEN q3 - q1 END AS iqr, CASE WHEN q3 - q1 = 0 THEN (high - low) / 4 ELSE q3 - q1 END AS width, CASE WHEN n < 15 THEN 2.2 ELSE 1.5 END AS k FROM d)
SELECT session_id, n, round(med, 6) AS median, round(mad, 6) AS mad, round(iqr, 6) AS iqr,
  round(CASE WHEN n < 3 THEN 1 WHEN mad > 0 THEN greatest(mad, 1) WHEN iqr > 0 THEN greatest(iqr / 1.35, 1) WHEN abs(med) > 0 THEN greatest(0.1 * abs(med), 1) ELSE 1 END, 6) AS spread,
  round(CASE WHEN n >= 4 AND width > 0 THEN q1 - k * width END, 6) AS lower_fence, round(CASE WHEN n >= 4 AND width > 0 THEN q3 + k * width END, 6) AS upper_fence FROM e""")
def q_robust_stats(spark: SparkSession, d: str) -> DataFrame:
    """Exact median, scaled MAD, hinge spread, fallback spread and fences."""
    rows = table(spark, d, "merges").where(F.col("dx").isNotNull() & ~F.isnan("dx")).select("session_id", "dx")
    out = S.robust_summary(rows, ["session_id"], "dx")
    return out.select("session_id", "n", *[_r(c).alias(c) for c in ("median", "mad", "iqr", "spread", "lower_fence", "upper_fence")])


@query(f"""
WITH {_CLEAN}, g AS (SELECT session_id, list_sort(list(dx)) AS a, len(list(dx)) AS n FROM m GROUP BY session_id)
SELECT session_id, n, round(list_avg(a), 3) AS mean, round(a[round(0.5 * (n - 1))::INT + 1], 3) AS p50, round(a[round(0.9 * (n - 1))::INT + 1], 3) AS p90, round(a[n], 3) AS high FROM g""")
def q_number_summary(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean, nearest-rank percentiles, maximum."""
    return S.number_summary(table(spark, d, "merges"), ["session_id"], "dx")


@query("""
SELECT session_id, count(*) AS n, count(*) FILTER (fromcache) AS cached, CASE WHEN count(*) <> 0 THEN round(count(*) FILTER (fromcache) * 1000 / count(*)) / 1000 END AS share FROM merges GROUP BY session_id""")
def q_share(spark: SparkSession, d: str) -> DataFrame:
    """A10: a share to three places, null of nothing."""
    out = table(spark, d, "merges").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("fromcache"), 1)).alias("cached"))
    return out.select("session_id", "n", "cached", S.share(F.col("cached"), F.col("n")).alias("share"))


@query("""
WITH v AS (SELECT session_id, round(abs(dy), 1) AS v FROM merges WHERE dy IS NOT NULL AND NOT isnan(dy) AND dy <> 0),
c AS (SELECT session_id, v, count(*) AS c FROM v GROUP BY ALL),
s AS (SELECT session_id, v, c, sum(c) OVER w AS w0, sum(c * v) OVER w AS s0, sum(c) OVER e AS n, sum(c * v) OVER e AS s, lead(v) OVER (PARTITION BY session_id ORDER BY v) AS nxt FROM c
  WINDOW w AS (PARTITION BY session_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), e AS (PARTITION BY session_id)),
b AS (SELECT *, CASE WHEN nxt IS NOT NULL THEN round((w0 / n) * ((n - w0) / n) * (s0 / w0 - (s - s0) / nullif(n - w0, 0)) ** 2, 12) END AS between_, c * (v - s / n) ** 2 AS spread FROM s),
g AS (SELECT session_id, arg_max((v + nxt) / 2, (between_, -v)) FILTER (between_ IS NOT NULL) AS cut, max(between_) AS best, sum(spread) / max(n) AS variance, max(n)::BIGINT AS n, min(v) AS low, max(v) AS high FROM b GROUP BY session_id),
m AS (SELECT session_id, median(v) AS med FROM v GROUP BY session_id)
SELECT session_id, n, round(coalesce(CASE WHEN n < 2 THEN NULL WHEN low = high THEN low + 1 WHEN n < 5 THEN 1.8 * med WHEN n < 10 THEN CASE WHEN high > 3 * med THEN (med + high) / 2 ELSE 1.8 * med END
  WHEN variance < 1e-6 OR best < 0.2 * variance THEN NULL ELSE cut END, 7.5), 4) AS threshold FROM g JOIN m USING (session_id)""")
def q_otsu(spark: SparkSession, d: str) -> DataFrame:
    """The movement that splits small from large ones best, 7.5 if none does."""
    rows = table(spark, d, "merges").where("dy is not null and not isnan(dy) and dy <> 0").select("session_id", F.round(F.abs("dy"), 1).alias("v"))
    return S.otsu(rows, ["session_id"], "v", 7.5).select("session_id", "n", _r("threshold", 4).alias("threshold"))


@query("""
WITH m AS (SELECT session_id, merge_id, cap, dx, dy FROM merges WHERE dx IS NOT NULL AND dy IS NOT NULL AND NOT isnan(dx) AND NOT isnan(dy)),
w AS (SELECT session_id, merge_id, count(*) OVER r AS samples, median(dx) OVER r AS mx, median(dy) OVER r AS my FROM m WINDOW r AS (PARTITION BY session_id ORDER BY cap, merge_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, CASE WHEN samples < 3 THEN 0 ELSE least(greatest(mx, -24), 24) END AS drift_x, CASE WHEN samples < 3 THEN 0 ELSE least(greatest(my, -24), 24) END AS drift_y FROM w)
SELECT merge_id AS id, samples, round(drift_x, 6) AS drift_x, round(drift_y, 6) AS drift_y, round(least(abs(drift_x) + abs(drift_y), 24), 6) AS margin FROM c""")
def q_drift_window(spark: SparkSession, d: str) -> DataFrame:
    """Running median drift of the last twenty merges, at a height of 24."""
    rows = table(spark, d, "merges").withColumn("height", F.lit(24.0))
    out = drift.running(rows.select("session_id", "merge_id", "cap", "dx", "dy", F.col("height").alias("h")), ["session_id"], ["cap", "merge_id"], "dx", "dy", "h")
    return out.select(F.col("merge_id").alias("id"), F.col("samples").cast("long").alias("samples"), *[_r(c).alias(c) for c in ("drift_x", "drift_y", "margin")])


@query(BASE + f"""
, w AS (SELECT *, {_weight()} AS weight, floor(t / 500)::INT AS region FROM obs),
k AS (SELECT session_id, region, t, CASE WHEN weight >= 30 THEN 'unknown:0' WHEN weight = 20 AND kind = 'inner' THEN CASE WHEN cid IS NULL THEN 'unknown:0' ELSE 'ic:' || cid || ':' || region END ELSE 'normal:' || region END AS skey FROM w),
z AS (SELECT session_id, skey, coalesce(try_cast(list_last(string_split(skey, ':')) AS INT), 0) AS region FROM k)
SELECT session_id, skey, region, count(*) AS observations FROM z WHERE NOT region BETWEEN 1 AND 2 GROUP BY ALL""")
def q_drift_keys(spark: SparkSession, d: str) -> DataFrame:
    """Observations per drift key outside the regions of 500 to 1499 px."""
    rows = drift.without_region(_obs(spark, d), 500, 1499, C.region_index(F.col("skey")))
    return drift.key_summary(rows, ["session_id", "skey"], C.region_index(F.col("skey"))).select("session_id", "skey", "region", "observations")


@query(BASE + """
SELECT id, CASE WHEN t - lag(b) OVER w > 0 THEN round(t - lag(b) OVER w, 6) END AS gap, row_number() OVER w AS place FROM obs WHERE (r - l) * (b - t) > 0 AND length(text) / ((r - l) * (b - t)) >= 0.00005
WINDOW w AS (PARTITION BY session_id, cap ORDER BY t, l, seq, id)""")
def q_reading_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between dense blocks in reading order."""
    area = blocks.box().area
    rows = _obs(spark, d).where((area > 0) & (T.density(F.col("text"), area) >= 0.00005))
    w = Window.partitionBy("session_id", "cap").orderBy("t", "l", "seq", "id")
    gap = F.col("t") - F.lag("b").over(w)
    return rows.select("id", F.when(gap > 0, _r(gap)).alias("gap"), F.row_number().over(w).cast("long").alias("place"))


@query(BASE + """
, m AS (SELECT id, l, t, r, b, 1.25 AS a, 0.1 AS q, -0.05 AS c, 0.8 AS d, 12.0 AS tx, -7.0 AS ty FROM obs),
c AS (SELECT id, (d * (x - tx) - c * (y - ty)) / (a * d - q * c) AS u, (a * (y - ty) - q * (x - tx)) / (a * d - q * c) AS v FROM (SELECT *, unnest([l, l, r, r]) AS x, unnest([t, b, t, b]) AS y FROM m))
SELECT id, round(min(u), 6) AS l, round(min(v), 6) AS t, round(max(u), 6) AS r, round(max(v), 6) AS b FROM c GROUP BY id""")
def q_inverse_transform(spark: SparkSession, d: str) -> DataFrame:
    """Every rectangle with an affine map undone."""
    undone = G.inverse_transform(blocks.box(), [F.lit(x) for x in (1.25, 0.1, -0.05, 0.8, 12.0, -7.0)])
    return _obs(spark, d).select("id", *[_r(e).alias(n) for e, n in zip(undone.edges, "ltrb")])


@query("""
SELECT session_id, cap, count(*) AS blocks, round(min(rect[1]), 4) AS l, round(min(rect[2]), 4) AS t, round(max(rect[3]), 4) AS r, round(max(rect[4]), 4) AS b, round(avg(pconf), 6) AS pconf FROM obs_blocks GROUP BY session_id, cap""")
def q_capture_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Bounding box and mean confidence of every capture."""
    e = [F.get("rect", F.lit(i)) for i in range(4)]
    return table(spark, d, "obs_blocks").groupBy("session_id", "cap").agg(F.count(F.lit(1)).alias("blocks"), _r(F.min(e[0]), 4).alias("l"), _r(F.min(e[1]), 4).alias("t"), _r(F.max(e[2]), 4).alias("r"), _r(F.max(e[3]), 4).alias("b"), _r(F.avg("pconf")).alias("pconf"))


# --- order-dependent plans and reports -----------------------------------------------------


def _replayed(spark: SparkSession, d: str, arms: dict | None = None, **log) -> DataFrame:  # noqa: ANN003
    return replay.replay(_obs(spark, d), arms, table(spark, d, "captures"), **log)


@query()
def q_track_session(spark: SparkSession, d: str) -> DataFrame:
    """ST1-ST6, ST8-ST12, D4, D5: the decision of every merge of every session."""
    log = _replayed(spark, d).where("event = 'merge'")
    return log.select("session_id", "cap", "how", "fresh_id", "track", _r("dx").alias("dx"), _r("dy").alias("dy"), "obs_before", _r("pconf").alias("pconf"), _r("tconf").alias("tconf"), "response")


@query()
def q_track_census(spark: SparkSession, d: str) -> DataFrame:
    """A16, A18, ST9, ST10, A25: census, shift and state digest of every capture."""
    log = _replayed(spark, d).where("event = 'capture'")
    return log.select("session_id", "cap", "merged", "admitted", "retained", "dropped", "contradictions", "invalidated", "settled", _r("shift_x").alias("shift_x"), _r("shift_y").alias("shift_y"), "shift_members", _r("scale").alias("scale"), "digest")


@query()
def q_drift_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Every region whose drift moved on, by capture."""
    log = _replayed(spark, d).where("event = 'drift'")
    return log.select("session_id", "cap", F.col("how").alias("skey"), _r("dx").alias("dx"), _r("dy").alias("dy"))


@query()
def q_bucket_policy(spark: SparkSession, d: str) -> DataFrame:
    """A28, J2d, ST16: census with cells that follow the median height of the tracks."""
    log = replay.replay(_obs(spark, d), None, table(spark, d, "captures"), replay.median_cells).where("event = 'capture'")
    return log.select("session_id", "cap", "merged", "admitted", "dropped", "digest")


@query(BASE + f"""
, w AS (SELECT *, {_weight()} AS weight, floor(t / 500)::INT AS region FROM trk),
k AS (SELECT session_id, obs, CASE WHEN weight >= 30 THEN 'unknown:0' WHEN weight = 20 AND kind = 'inner' THEN CASE WHEN cid IS NULL THEN 'unknown:0' ELSE 'ic:' || cid || ':' || region END ELSE 'normal:' || region END AS skey FROM w)
SELECT session_id, skey, count(*) AS tracks, count(*) FILTER (obs < 3) AS uncorrected FROM k GROUP BY ALL""")
def q_uncorrected(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of each drift key, and those seen fewer than three times."""
    return _trk(spark, d).groupBy("session_id", "skey").agg(F.count(F.lit(1)).alias("tracks"), F.count(F.when(F.col("obs") < lifecycle.WELL_OBSERVED, 1)).alias("uncorrected"))


@query(BASE + """
, g AS (SELECT session_id, cap, count(*) AS blocks, count(*) <= 1 AS alone, count(DISTINCT text) AS texts, CASE WHEN count(*) > 1 THEN list_sort(list(text)) END AS sorted FROM obs GROUP BY session_id, cap)
SELECT session_id, cap, blocks, alone, texts, min(cap) OVER (PARTITION BY session_id, sorted) AS first_like FROM g""")
def q_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Captures whose signature is 0, and the first capture with an equal signature."""
    texts = _obs(spark, d).groupBy("session_id", "cap").agg(F.collect_list("text").alias("texts"))
    rows = texts.select("session_id", "cap", "texts", C.group_signature(F.col("texts")).alias("signature"))
    first = rows.groupBy("session_id", "signature").agg(F.min("cap").alias("first_like"))
    return rows.join(first, ["session_id", "signature"]).select("session_id", "cap", F.size("texts").cast("long").alias("blocks"), (F.col("signature") == 0).alias("alone"), F.size(F.array_distinct("texts")).cast("long").alias("texts"), "first_like")


@query()
def q_ab_bands(spark: SparkSession, d: str) -> DataFrame:
    """A22, ST15, ST17: movement by maturity under every arm."""
    return reports.displacement_bands(_replayed(spark, d, replay.ARMS, events=("merge",), columns=("arm", "event", "how", "obs_before", "dx", "dy")))


@query()
def q_arm_summary(spark: SparkSession, d: str) -> DataFrame:
    """Confidence, saturation, lag and step events of every arm."""
    return reports.arm_summary(_replayed(spark, d, replay.ARMS, events=("merge",), columns=("arm", "event", "how", "obs_before", "top_lag", "pconf", "response")))


@query()
def q_arm_digests(spark: SparkSession, d: str) -> DataFrame:
    """One digest for each arm."""
    return reports.arm_digests(_replayed(spark, d, replay.ARMS, events=("capture",), columns=("session_id", "arm", "cap", "event", "digest")))


@query()
def q_half_of_damp(spark: SparkSession, d: str) -> DataFrame:
    """Arms that halve the lag of damping."""
    return reports.half_of_damp(_replayed(spark, d, replay.ARMS, events=("merge",), columns=("session_id", "arm", "event", "top_lag")))


@query()
def q_step_rule(spark: SparkSession, d: str) -> DataFrame:
    """Lag of every arm at a move, three and five captures later, against the damped arm."""
    return reports.step_rule(_replayed(spark, d, replay.ARMS, events=("merge", "capture"), columns=("session_id", "arm", "cap", "event", "top_lag")))


@query()
def q_capture_series(spark: SparkSession, d: str) -> DataFrame:
    """Lag, step events and identity share of every capture."""
    return reports.capture_series(_replayed(spark, d), table(spark, d, "captures"))


@query("""
WITH h AS (SELECT session_id, count(*) AS freezes, count(*) FILTER (differs) AS differing, count(*) FILTER (differs AND freshtconf >= 0.8 AND NOT isnan(freshtconf)) AS confident_discards, count(*) FILTER (remaining <= 1) AS expiring FROM freezes GROUP BY session_id),
m AS (SELECT session_id, count(*) AS merges FROM merges GROUP BY session_id)
SELECT session_id, coalesce(merges, 0) AS merges, coalesce(freezes, 0) AS freezes, coalesce(differing, 0) AS differing, coalesce(confident_discards, 0) AS confident_discards, coalesce(expiring, 0) AS expiring,
  round(coalesce(freezes, 0) * 1000 / (coalesce(freezes, 0) + coalesce(merges, 0))) / 1000 AS frozen_share FROM m FULL JOIN h USING (session_id)""")
def q_freeze_report(spark: SparkSession, d: str) -> DataFrame:
    """The freeze funnel of every session."""
    return reports.freeze_report(table(spark, d, "freezes"), table(spark, d, "merges"))


@query("""
WITH x AS (SELECT session_id, 'engine' AS t FROM captures UNION ALL SELECT session_id, 'merge' FROM merges UNION ALL SELECT session_id, 'freeze' FROM freezes)
SELECT session_id, count(*) FILTER (t = 'engine') AS engine, count(*) FILTER (t = 'merge') AS merge, count(*) FILTER (t = 'freeze') AS freeze,
  CASE WHEN count(*) FILTER (t <> 'engine') <> 0 THEN round(count(*) FILTER (t = 'freeze') * 1000 / count(*) FILTER (t <> 'engine')) / 1000 END AS frozen_share FROM x GROUP BY session_id""")
def q_live_report(spark: SparkSession, d: str) -> DataFrame:
    """Event counts of every session."""
    return reports.live_report(table(spark, d, "merges"), table(spark, d, "freezes"), table(spark, d, "captures"))


@query()
def q_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """ST13, G21, R2: paragraph and position of every block."""
    return paragraphs.paragraphs(_obs(spark, d))


def _lined(spark: SparkSession, d: str) -> DataFrame:
    """Every capture read as one block that comes with its lines."""
    line = F.struct("seq", "id", "text", *"ltrb")
    rows = _obs(spark, d).groupBy("session_id", "cap").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.min("id").alias("id"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))
    return rows.withColumn("text", F.array_join("lines.text", " "))


@query(BASE + """
, x AS (SELECT *, right(text, 1) IN ('。', '！', '？', '…') AS ends, row_number() OVER w AS place, count(*) OVER (PARTITION BY session_id, cap) AS n FROM obs WINDOW w AS (PARTITION BY session_id, cap ORDER BY seq, id)),
y AS (SELECT *, coalesce(count(*) FILTER (ends) OVER (PARTITION BY session_id, cap ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, bool_or(ends AND place < n) OVER (PARTITION BY session_id, cap) AS cut FROM x)
SELECT session_id, cap, count(*)::INT AS lines, string_agg(text, ' ' ORDER BY place) AS text, round(min(l), 4) AS l, round(min(t), 4) AS t, round(max(r), 4) AS r, round(max(b), 4) AS b FROM y WHERE cut GROUP BY session_id, cap, run""")
def q_sentence_units(spark: SparkSession, d: str) -> DataFrame:
    """M6, U5, ST13: blocks with lines, cut after each line that ends a sentence."""
    rows = _lined(spark, d)
    cut = rows.where(F.exists(F.slice("lines", 1, F.size("lines") - 1), lambda x: T.ends_sentence(x["text"])))
    units = paragraphs.line_units(cut)
    return units.select("session_id", "cap", "lines", "text", *[_r(e, 4).alias(e) for e in "ltrb"])


@query(BASE + "SELECT session_id, cap, id, (row_number() OVER (PARTITION BY session_id, cap ORDER BY id) - 1)::INT AS piece, text FROM obs")
def q_by_lines(spark: SparkSession, d: str) -> DataFrame:
    """ST14: every block a unit of its own."""
    rows = _obs(spark, d).withColumn("lines", F.array().cast("array<struct<text:string,l:double,t:double,r:double,b:double>>"))
    return paragraphs.line_units(rows, None).select("session_id", "cap", "id", "piece", "text")


@query()
def q_paragraph_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every boundary decision of the grouping with all reasons."""
    out = paragraphs.decisions(_obs(spark, d))
    return out.select("session_id", "cap", "id", "accepted", F.array_join("reasons", ",").alias("reasons"), "length", _r("gap").alias("gap"), _r("threshold").alias("threshold"))


@query()
def q_pregroup(spark: SparkSession, d: str) -> DataFrame:
    """Captures rewritten as paragraph units."""
    obs = _obs(spark, d)
    return captures.pregroup(obs, paragraphs.paragraphs(obs)).select("session_id", "cap", "paragraph", *[_r(e).alias(e) for e in "ltrb"], "text", _r("pconf").alias("pconf"), _r("tconf").alias("tconf"), "members")


def _geometry(spark: SparkSession, d: str) -> DataFrame:
    """Capture geometry on the recorded viewports: a fixed header, a side rail to leave
    out, and one carousel."""
    view = table(spark, d, "sessions").select("session_id", F.coalesce(F.get("vp", F.lit(0)), F.lit(800.0)).alias("w"), F.coalesce(F.get("vp", F.lit(1)), F.lit(900.0)).alias("h"))
    rect = lambda *e: F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in e])
    rows = table(spark, d, "captures").select("session_id", "cap").distinct().join(view, "session_id")
    return rows.select(
        "session_id", "cap", F.lit(2.0).alias("scale"), F.lit(0.0).alias("scroll_x"), F.lit(120.0).alias("scroll_y"), F.lit(40.0).alias("page_top"), F.col("h").alias("view_height"),
        F.struct(F.lit(400.0).alias("top"), F.lit(200.0).alias("height"), F.lit("list").alias("cid")).alias("inner"),
        F.array(F.struct(rect(0, 0, F.col("w"), 60).alias("rect"), F.lit(False).alias("fixed"))).alias("sticky"), F.array(rect(0, 900, 120, 1200)).alias("exclusions"),
        F.array(F.struct(rect(0, 600, F.col("w"), 700).alias("rect"), F.lit(80.0).alias("scroll_left"), (F.col("cap") % 2 == 0).alias("animating"))).alias("carousels"), F.lit(650).alias("age_ms"),
    )


@query(f"""
WITH v AS (SELECT session_id, coalesce(vp[1], 800) AS w, coalesce(vp[2], 900) AS vh FROM sessions),
g AS (SELECT DISTINCT c.session_id, c.cap, w, vh FROM captures c JOIN v USING (session_id)),
x AS (SELECT o.session_id, o.cap, o.block_id AS id, otext, rect[1] * 0.5 AS l, rect[2] * 0.5 AS t, rect[3] * 0.5 AS r, rect[4] * 0.5 AS b, tconf, w, vh FROM obs_blocks o JOIN g USING (session_id, cap) WHERE otext IS NOT NULL),
c AS (SELECT *, l + (r - l) / 2 AS cx, t + (b - t) / 2 AS cy, b - t AS h, (r - l) * (b - t) AS area, greatest(least(r, w) - greatest(l, 0), 0) * greatest(least(b, 60) - greatest(t, 0), 0) AS top_area, greatest(least(r, 120) - greatest(l, 0), 0) * greatest(least(b, 1200) - greatest(t, 900), 0) AS rail FROM x),
q AS (SELECT session_id, cap, list_sort(list(h)) AS hs, count(*) AS n FROM c GROUP BY ALL),
f AS (SELECT session_id, cap, n, list_aggregate(hs[1:n // 2], 'median') AS q1, list_aggregate(hs[n - n // 2 + 1:n], 'median') AS q3, hs[1] AS low, hs[n] AS high FROM q),
k AS (SELECT session_id, cap, CASE WHEN n >= 4 AND CASE WHEN q3 - q1 = 0 THEN (high - low) / 4 ELSE q3 - q1 END > 0 THEN q3 + (CASE WHEN n < 15 THEN 2.2 ELSE 1.5 END) * CASE WHEN q3 - q1 = 0 THEN (high - low) / 4 ELSE q3 - q1 END END AS fence FROM f),
s AS (SELECT c.*, fence, cx >= 0 AND cx <= w AND cy >= 0 AND cy <= 60 AND top_area / area >= 0.5 AS sticky, CASE WHEN cx >= 0 AND cx <= w AND cy >= 600 AND cy <= 700 THEN 0 ELSE -1 END AS lane FROM c JOIN k USING (session_id, cap)),
i AS (SELECT *, NOT sticky AND cy >= 360 AND cy < 560 AS inner_ FROM s),
z AS (SELECT *, CASE WHEN sticky THEN 0 WHEN lane >= 0 THEN 80 ELSE 0 END AS dx, CASE WHEN sticky THEN 0 WHEN inner_ THEN 120 ELSE 40 END AS dy, avg(h) OVER (PARTITION BY session_id, cap) AS tall FROM i),
last AS (SELECT session_id, text, rect[1] * 0.5 AS x, rect[2] * 0.5 + 40 AS y FROM tracks),
away AS (SELECT z.id, min(sqrt((l + dx - x) ** 2 + (t + dy - y) ** 2)) AS delta FROM z JOIN last ON z.session_id = last.session_id AND z.otext = last.text GROUP BY z.id),
lim AS (SELECT z.*, delta, least(greatest(0.15 * tall, 5), 20) AS lo, least(greatest(tall, 30), 120) AS hi, length(otext) AS n, length(regexp_replace(otext, '[^{CJK}]', '', 'g'))::DOUBLE / greatest(length(otext), 1) AS cjk,
  list_max(list_transform(list_distinct(list_transform(range(1, length(otext) + 1), lambda i: substr(otext, i, 1))), lambda c: length(otext) - length(replace(otext, c, ''))))::DOUBLE / greatest(length(otext), 1) AS dom FROM z LEFT JOIN away USING (id))
SELECT session_id, cap, id, CASE WHEN NOT sticky AND rail / area >= 0.5 THEN 'excluded' WHEN NOT sticky AND lane >= 0 AND cap % 2 = 0 THEN 'deferred' WHEN h > greatest(coalesce(fence, 0.6 * vh), 0.3 * vh) THEN 'too_tall' ELSE 'classified' END AS fate,
  CASE WHEN sticky THEN 'viewport' WHEN inner_ THEN 'inner' ELSE 'page' END AS kind, CASE WHEN sticky THEN -1 ELSE lane END AS hz, sticky AS from_sticky, CASE WHEN inner_ THEN 'list' END AS cid,
  round(l + dx, 6) AS l, round(t + dy, 6) AS t, round(r + dx, 6) AS r, round(b + dy, 6) AS b, round(0.5 * (1 - 450 / 1800.0::DOUBLE * 0.7) + 0.5 * (CASE WHEN delta IS NULL THEN 0.5 WHEN delta <= lo THEN 1.0 WHEN delta >= hi THEN 0.3 ELSE 1.0 - (delta - lo) / (hi - lo) * 0.7 END), 6) AS pconf,
  round(coalesce(tconf, CASE WHEN n = 0 THEN 0.3 ELSE 0.5 * (0.5 + 0.4 * cjk) + 0.3 * (CASE WHEN n <= 2 THEN 0.5 WHEN dom > 0.6 THEN 0.5 + 0.5 * (1 - dom) ELSE 1 END) + 0.2 * (CASE WHEN (r - l) / nullif(h * n, 0) > 3 THEN 0.6 WHEN (r - l) / nullif(h * n, 0) > 2 THEN 0.8 ELSE 1 END) END), 6) AS tconf FROM lim""")
def q_classify(spark: SparkSession, d: str) -> DataFrame:
    """Observations as groups of a capture at twice the page's
    scale, with the tracks as the last known positions; a missing confidence is estimated."""
    e = [F.get("rect", F.lit(i)).alias(n) for i, n in enumerate("ltrb")]
    groups = table(spark, d, "obs_blocks").where("otext is not null").select("session_id", "cap", F.col("block_id").alias("id"), *e, F.col("otext").alias("text"), F.col("tconf").alias("conf"))
    known = table(spark, d, "tracks").select("session_id", "text", (F.get("rect", F.lit(0)) * 0.5).alias("x"), (F.get("rect", F.lit(1)) * 0.5 + 40).alias("y"))
    return classify.classify(groups, _geometry(spark, d), positions=known)


@query("""
SELECT session_id, cap, seq, round(rect[1], 6) AS l, otext, pconf, coalesce(srcq, 0) AS srcq FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, cap ORDER BY seq, block_id) AS place FROM obs_blocks)""")
def q_jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Captures written as JSON lines and read again."""
    lines = captures.to_lines(table(spark, d, "obs_blocks"))
    back = captures.blocks(captures.records(lines.drop("cap")), ["session_id"]).withColumnRenamed("seq", "place")
    order = Window.partitionBy("session_id", "cap").orderBy("seq", "block_id")
    seqs = table(spark, d, "obs_blocks").select("session_id", "cap", "seq", (F.row_number().over(order) - 1).alias("place"))
    return back.join(seqs, ["session_id", "cap", "place"]).select("session_id", "cap", "seq", _r(F.get("rect", F.lit(0))).alias("l"), "otext", "pconf", "srcq")
