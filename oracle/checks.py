"""DuckDB SQL per registered query, composed from common table expressions.

Every text is one statement on the given tables. The parts follow the meaning of each step, not
the Spark expressions: thresholds by direct scan, clusters by transitive closure, ranks for AUC.
"""

from __future__ import annotations

from rowkin.plans.fixture import ROWS_SQL as SOURCE_ROWS

AREAS = ("11|220|221|223|230|236|237|249|260|261|263|264|266|280|291|294|297|298|299|336|341|342|343|345|348|351|353|"
         "358|362|364|370|376|379|380|381|383|385|387|388")
MASTER_FIELDS = ("given_name", "family_name", "email", "phone_e164", "birth_date", "city", "address")
ENTITY_FIELDS = ("entity_key", "source", "source_id", "given_name", "family_name", "full_name_norm", "family_soundex",
                 "email", "phone_e164", "birth_date", "city", "address", "updated_at")


# --- expressions --------------------------------------------------------------------------------

def norm_text(x: str) -> str:
    ascii_text = f"strip_accents(replace({x}, 'ß', 'ss'))"
    return f"nullif(trim(regexp_replace(lower({ascii_text}), '[^a-z0-9]+', ' ', 'g')), '')"


def display(x: str) -> str:
    t = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    chars = (f"list_transform(range(1, length({t}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
             f"regexp_matches(substr({t}, i - 1, 1), '\\p{{L}}') THEN upper(substr({t}, i, 1)) ELSE lower(substr({t}, i, 1)) END)")
    return f"nullif(array_to_string({chars}, ''), '')"


def soundex(word: str) -> str:
    """Letters h and w dropped after the first, letters to digits, runs collapsed, vowels dropped."""
    body = f"(substr({word}, 1, 1) || regexp_replace(substr({word}, 2), '[hw]', '', 'g'))"
    x = f"translate({body}, 'bfpvcgjkqsxzdtlmnraeiouyhw', '11112222222233455600000000')"
    for d in "0123456":
        x = f"regexp_replace({x}, '{d}+', '{d}', 'g')"
    return f"(upper(substr({word}, 1, 1)) || substr(replace(substr({x}, 2), '0', '') || '000', 1, 3))"


def email(x: str) -> str:
    e = f"lower(trim({x}))"
    domain = f"substr({e}, strpos({e}, '@') + 1)"
    local = f"split_part(split_part({e}, '@', 1), '+', 1)"
    local = f"CASE WHEN {domain} = 'gmail.com' THEN replace({local}, '.', '') ELSE {local} END"
    return f"CASE WHEN strpos({x}, '@') > 0 AND ({local}) <> '' THEN ({local}) || '@' || {domain} END"


def phone(x: str) -> str:
    digits = f"regexp_replace({x}, '\\D', '', 'g')"
    national = f"regexp_replace(regexp_replace({digits}, '^54', ''), '^0', '')"
    mobile = (f"CASE WHEN length({national}) = 12 THEN regexp_replace({national}, '^({AREAS}|[23]\\d{{3}})15(\\d{{6,8}})$', "
              f"'9\\1\\2') ELSE {national} END")
    return f"CASE WHEN regexp_full_match({mobile}, '9?(11|[23]\\d)\\d{{8}}') THEN '+54' || ({mobile}) END"


def date(x: str) -> str:
    return f"CAST(try_strptime({x}, ['%Y-%m-%d', '%d/%m/%Y']) AS DATE)"


def address(x: str) -> str:
    t = f"regexp_replace(' ' || {norm_text(x)} || ' ', '\\bpiso \\d+\\b', '', 'g')"
    t = f"replace(replace({t}, ' av ', ' avenida '), ' calle ', ' ')"
    return f"nullif(trim(regexp_replace({t}, ' +', ' ', 'g')), '')"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence by bits: bit i is cleared when position i of ``a`` gets matched."""
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    hits = (f"list_transform(string_split({b}, ''), lambda c: coalesce(list_sum(list_transform(range(1, length({a}) + 1), "
            f"lambda i: CASE WHEN substr({a}, i, 1) = c THEN (1::HUGEINT << (i - 1)::INT) ELSE 0::HUGEINT END)), 0)::HUGEINT)")
    left = f"list_reduce({hits}, lambda v, m: ((v + (v & m)) | (v & ({full} - m))) & {full}, {full})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count({left}) END"


def split_of(person: str) -> str:
    def half(start: int) -> str:
        return f"(('0x' || substr(md5({person}), {start}, 16))::UBIGINT % 10)::INT"

    return f"CASE WHEN ({half(1)} * 6 + {half(17)}) % 10 < 6 THEN 'dev' ELSE 'test' END"


def uuid5(key: str) -> str:
    h = f"sha1('\\x6f\\x1c\\x2d\\x8e\\x5b\\x1a\\x4c\\x3e\\x9a\\x57\\x3d\\x2f\\x0e\\x8b\\x7c\\x41'::BLOB || encode({key}))"
    variant = f"substr('89ab', (('0x' || substr({h}, 17, 1))::INT & 3) + 1, 1)"
    return (f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || "
            f"substr({h}, 18, 3) || '-' || substr({h}, 21, 12))")


def logistic(weights: tuple[float, ...], intercept: float, score: str | None = None) -> str:
    terms = []
    w = iter(weights)
    for f in ("email_agree", "phone_agree", "birth_agree", "city_agree"):
        terms.append(_agree_term(f, next(w), next(w)))
    terms.append(f"{next(w)}::DOUBLE * name_sim")
    terms.append(f"{next(w)}::DOUBLE * address_sim")
    if score:
        terms.append(f"{next(w)}::DOUBLE * coalesce({score}, 0.5)")
    return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({intercept}::DOUBLE + {' + '.join(terms)})))"


def _agree_term(column: str, equal: float, different: float) -> str:
    return f"CASE {column} WHEN 1 THEN {equal}::DOUBLE WHEN -1 THEN {different}::DOUBLE ELSE 0::DOUBLE END"


def rounded(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


# --- common table expressions -------------------------------------------------------------------

def _entities(source: str, ident: str, given: str, family: str, birth: str, table: str) -> str:
    return f"""SELECT '{source}:' || {ident} AS entity_key, '{source}' AS source, {ident} AS source_id,
  {display(given)} AS given_name, {display(family)} AS family_name,
  {norm_text(given + " || ' ' || " + family)} AS full_name_norm,
  {soundex("split_part(" + norm_text(family) + ", ' ', 1)")} AS family_soundex,
  {email('email')} AS email, {phone('phone')} AS phone_e164, {birth} AS birth_date,
  {norm_text('city')} AS city, {address('address')} AS address, CAST(updated_at AS TIMESTAMP) AS updated_at
  FROM {table}"""


ENTITIES = f"""crm_users AS (SELECT id AS crm_id, given AS first_name, family AS last_name, email, phone, birth AS birth_date,
    address, city, updated_at FROM w WHERE src = 'crm'),
billing_users AS (SELECT id AS billing_id, CASE WHEN r_case % 2 = 0 THEN family || ', ' || given ELSE given || ' ' || family END
    AS full_name, email, phone, address AS billing_address, city, updated_at FROM w WHERE src = 'billing'),
billing_named AS (SELECT billing_id, email, phone, billing_address AS address, city, updated_at,
    CASE WHEN strpos(full_name, ',') > 0 THEN trim(substr(full_name, strpos(full_name, ',') + 1)) ELSE split_part(full_name, ' ', 1) END AS given,
    CASE WHEN strpos(full_name, ',') > 0 THEN trim(split_part(full_name, ',', 1))
         ELSE trim(substr(full_name, length(split_part(full_name, ' ', 1)) + 1)) END AS family FROM billing_users),
crm_entities AS ({_entities('crm', 'crm_id', 'first_name', 'last_name', date('birth_date'), 'crm_users')}),
billing_entities AS ({_entities('billing', 'billing_id', 'given', 'family', 'CAST(NULL AS DATE)', 'billing_named')}),
entities AS MATERIALIZED (SELECT * FROM crm_entities UNION ALL SELECT * FROM billing_entities),
truth AS MATERIALIZED (SELECT src || ':' || id AS entity_key, person_id AS true_entity_id, {split_of('person_id')} AS split FROM w)"""

def _sized(name: str, source: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY block) AS records FROM ({source}))"


_KEYS = """SELECT entity_key, phone_e164, birth_date, given_name, unnest(list_filter(['e:' || email, 'p:' || phone_e164,
    's:' || family_soundex || '|' || city], lambda x: x IS NOT NULL)) AS block FROM entities"""
_GIVEN_SOUND = soundex("split_part(" + norm_text("given_name") + ", ' ', 1)")


def _split(level: int, source: str, letter: str, key: str, limit: int) -> str:
    """One level of the trees: nodes of ``source`` over the limit are split by a key, small parts packed in the order of their keys."""
    half = max(1, limit // 2)
    return f"""cut{level} AS MATERIALIZED (SELECT * EXCLUDE (records, block), block AS node, coalesce({key}, '') AS part FROM {source} WHERE records > {limit}),
parts{level} AS (SELECT node, part, count(*) AS n FROM cut{level} GROUP BY ALL),
packed{level} AS (SELECT node, part, CASE WHEN n > {half} THEN node || '|{letter}:' || part ELSE node || '|{letter}~' || coalesce(sum(CASE WHEN n <= {half} THEN n END)
    OVER (PARTITION BY node ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {half} END AS block FROM parts{level}),
{_sized(f'tree{level}', f"SELECT cut{level}.* EXCLUDE (node, part), block FROM cut{level} JOIN packed{level} USING (node, part)")}"""


def blocks(limit: int) -> str:
    """Blocks, their trees, the members of every leaf within the limit, and the pairs these form."""
    return f"""{_sized('blocks', f"SELECT *, block AS origin FROM ({_KEYS})")},
{_split(1, 'blocks', 'g', _GIVEN_SOUND, limit)},
{_split(2, 'tree1', 't', 'right(phone_e164, 4)', limit)},
{_split(3, 'tree2', 'y', "year(birth_date)::VARCHAR", limit)},
grouped AS MATERIALIZED (SELECT level, origin, block, list(entity_key ORDER BY entity_key) AS members FROM (
    SELECT 0 AS level, origin, entity_key, block, records FROM blocks UNION ALL SELECT 1, origin, entity_key, block, records FROM tree1
    UNION ALL SELECT 2, origin, entity_key, block, records FROM tree2 UNION ALL SELECT 3, origin, entity_key, block, records FROM tree3)
    WHERE records <= {limit} GROUP BY level, origin, block),
met AS MATERIALIZED (SELECT level, members[i] AS left_key, unnest(members[i + 1:]) AS right_key
    FROM (SELECT *, unnest(range(1, len(members))) AS i FROM grouped WHERE len(members) > 1)),
candidates AS MATERIALIZED (SELECT DISTINCT left_key, right_key FROM met)"""


BLOCKS = blocks(50)


def _agree(name: str, column: str) -> str:
    return (f"CASE WHEN l.{column} IS NULL OR r.{column} IS NULL THEN 0 WHEN l.{column} = r.{column} THEN 1 ELSE -1 END "
            f"AS {name}")


def _words(x: str) -> str:
    return f"list_distinct(string_split({x}, ' '))"


def _rest(a: str, b: str) -> str:
    return f"array_to_string(list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x))), ' ')"


def _similarity(prefix: str) -> str:
    a, b, n = f"{prefix}_a", f"{prefix}_b", f"{prefix}_n"
    gap = f"(CASE WHEN {n} > 0 THEN 1 ELSE 0 END)"
    la, lb = f"length({a})", f"length({b})"

    def ratio(distance: str, total: str) -> str:
        return f"((100.0::DOUBLE - 100.0::DOUBLE * ({distance}) / greatest({total}, 1)) / 100.0::DOUBLE)"

    rest = ratio(f"{la} + {lb} - 2 * {prefix}_lcs", f"2 * ({n} + {gap}) + {la} + {lb}")
    with_a, with_b = ratio(f"{gap} + {la}", f"2 * {n} + {gap} + {la}"), ratio(f"{gap} + {lb}", f"2 * {n} + {gap} + {lb}")
    return (f"CASE WHEN {n} IS NULL THEN 0.0::DOUBLE WHEN {n} > 0 AND ({a} = '' OR {b} = '') THEN 1.0::DOUBLE "
            f"WHEN {n} > 0 THEN greatest({rest}, {with_a}, {with_b}) ELSE {rest} END")


def _parts(prefix: str, column: str) -> str:
    wl, wr = _words(f"l.{column}"), _words(f"r.{column}")
    return (f"{_rest(wl, wr)} AS {prefix}_a, {_rest(wr, wl)} AS {prefix}_b, "
            f"length(array_to_string(list_filter({wl}, lambda x: list_contains({wr}, x)), ' ')) AS {prefix}_n")


FEATURES = f"""compared AS MATERIALIZED (SELECT left_key, right_key, {_agree('email_agree', 'email')}, {_agree('phone_agree', 'phone_e164')},
  {_agree('birth_agree', 'birth_date')}, {_agree('city_agree', 'city')}, {_parts('nm', 'full_name_norm')}, {_parts('ad', 'address')}
  FROM candidates JOIN entities l ON l.entity_key = left_key JOIN entities r ON r.entity_key = right_key),
matched AS MATERIALIZED (SELECT *, {lcs('nm_a', 'nm_b')} AS nm_lcs, {lcs('ad_a', 'ad_b')} AS ad_lcs FROM compared),
features AS MATERIALIZED (SELECT substr(sha1(left_key || '|' || right_key), 1, 16) AS pair_id, left_key, right_key, email_agree, phone_agree,
  birth_agree, city_agree, {_similarity('nm')} AS name_sim, {_similarity('ad')} AS address_sim, birth_agree = -1 AS birth_date_conflict FROM matched),
pairs AS MATERIALIZED (SELECT * FROM features WHERE email_agree = 1 OR phone_agree = 1 OR name_sim >= 0.6),
known AS (SELECT map(list(entity_key), list({{'person': true_entity_id, 'split': split}})) AS of FROM truth),
labeled AS MATERIALIZED (SELECT pairs.*, of[left_key].split AS split, of[left_key].person = of[right_key].person AS is_match FROM pairs, known)"""

RULES = logistic((5.0, -0.9, 4.5, -1.0, 3.0, -2.5, 0.5, -0.5, 6.0, 4.0), -10.37)
SECOND = logistic((3.0, -0.6, 2.5, -0.8, 2.0, -1.5, 0.3, -0.3, 4.0, 2.0, 6.0), -9.43, "p_same")


def _curve(name: str, scored: str) -> str:
    """Rows and hits beyond each threshold by scanning the dev rows once per threshold."""
    return f"""{name}_grid AS (SELECT i::INT AS i, (500 + 5 * i)::DOUBLE / 1000 AS t_high, (500 + 5 * i)::DOUBLE / 1000 - 0.495::DOUBLE AS t_low
  FROM range(100) g(i)),
{name} AS MATERIALIZED (SELECT i, t_high, count(*) FILTER (WHERE p_match >= t_high) AS rows_high,
  count(*) FILTER (WHERE p_match >= t_high AND is_match) AS hits_high, t_low,
  count(*) FILTER (WHERE p_match <= t_low) AS rows_low, count(*) FILTER (WHERE p_match <= t_low AND is_match) AS hits_low
  FROM {name}_grid LEFT JOIN (SELECT p_match, is_match FROM {scored} WHERE split = 'dev') ON true GROUP BY i, t_high, t_low)"""


def _tuned(name: str, curve: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT
  coalesce(min(t_high) FILTER (WHERE rows_high > 0 AND hits_high::DOUBLE / rows_high >= 0.98), 1.01::DOUBLE) AS tau_high,
  round(coalesce(max(t_low) FILTER (WHERE rows_low > 0 AND 1 - hits_low::DOUBLE / rows_low >= 0.98), -0.01::DOUBLE), 3) AS tau_low FROM {curve})"""


def _route(tau: str, invalid: str = "false") -> str:
    return (f"CASE WHEN {invalid} THEN 'REVIEW' WHEN p_match >= (SELECT tau_high FROM {tau}) THEN "
            f"CASE WHEN birth_date_conflict THEN 'REVIEW' ELSE 'MATCH' END "
            f"WHEN p_match <= (SELECT tau_low FROM {tau}) THEN 'NON_MATCH' ELSE 'REVIEW' END")


DECISIONS = f"""scored AS MATERIALIZED (SELECT *, {RULES} AS p_match FROM labeled),
{_curve('curve', 'scored')},
{_tuned('tuned', 'curve')},
decided AS MATERIALIZED (SELECT *, {_route('tuned')} AS decision FROM scored)"""


def _record(side: str) -> str:
    parts = [f"'{label}=' || coalesce({side}.{c}::VARCHAR, '')" for c, label in
             (("full_name_norm", "name"), ("email", "email"), ("phone_e164", "phone"), ("birth_date", "birth"),
              ("city", "city"), ("address", "address"))]
    return "concat_ws('; ', " + ", ".join(parts) + ")"


_SPLIT_A, _SPLIT_B = ("list_distinct(regexp_split_to_array(record_a, '[ ;]+'))", "list_distinct(regexp_split_to_array(record_b, '[ ;]+'))")
SECOND_STAGE = f"""numbered AS (SELECT pair_id, (row_number() OVER (ORDER BY pair_id) - 1) // 250 AS n FROM decided WHERE decision = 'REVIEW'),
batches AS MATERIALIZED (SELECT pair_id, 'b' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS batch_id FROM numbered),
texts AS (SELECT pair_id, batch_id, {_record('l')} AS record_a, {_record('r')} AS record_b FROM batches JOIN decided USING (pair_id)
  JOIN entities l ON l.entity_key = left_key JOIN entities r ON r.entity_key = right_key),
scores AS MATERIALIZED (SELECT pair_id, batch_id, 'overlap' AS checkpoint,
  len(list_intersect({_SPLIT_A}, {_SPLIT_B}))::DOUBLE / len(list_distinct(list_concat({_SPLIT_A}, {_SPLIT_B}))) AS p_same FROM texts),
queue AS MATERIALIZED (SELECT d.* EXCLUDE (p_match, decision), s.p_same FROM decided d LEFT JOIN scores s USING (pair_id) WHERE decision = 'REVIEW'),
queue_scored AS MATERIALIZED (SELECT *, {SECOND} AS p_match FROM queue),
{_curve('queue_curve', 'queue_scored')},
{_tuned('queue_tuned', 'queue_curve')},
second AS (SELECT pair_id, p_match, {_route('queue_tuned', 'p_same IS NULL')} AS decision FROM queue_scored),
overlay AS MATERIALIZED (SELECT d.pair_id, coalesce(s.p_match, d.p_match) AS p_match, coalesce(s.decision, d.decision) AS decision
  FROM decided d LEFT JOIN second s USING (pair_id)),
timing AS MATERIALIZED (SELECT 'given' AS run_id, batch_id, checkpoint, count(*)::INT AS pairs, 10.0::DOUBLE AS load_s, count(*) * 0.4::DOUBLE AS infer_s
  FROM scores GROUP BY batch_id, checkpoint),
true_pairs AS (SELECT split, sum(n * (n - 1) // 2)::BIGINT AS true_pairs FROM (SELECT split, true_entity_id, count(*) AS n FROM truth
  GROUP BY ALL) GROUP BY split)"""

CLUSTERS = f"""links AS (SELECT left_key AS a, right_key AS b FROM decided WHERE decision = 'MATCH'
  UNION SELECT right_key, left_key FROM decided WHERE decision = 'MATCH'),
reached(entity_key, other) AS (SELECT entity_key, entity_key FROM entities UNION SELECT r.entity_key, l.b FROM reached r JOIN links l ON l.a = r.other),
roots AS MATERIALIZED (SELECT entity_key, min(other) AS root_key FROM reached GROUP BY entity_key),
xref AS MATERIALIZED (SELECT entity_key, {uuid5('root_key')} AS master_id FROM roots),
pending AS MATERIALIZED (SELECT left_key AS entity_key FROM decided WHERE decision = 'REVIEW' UNION SELECT right_key FROM decided WHERE decision = 'REVIEW'),
master AS MATERIALIZED (SELECT master_id, {', '.join(
    f"(list({f} ORDER BY updated_at DESC NULLS LAST, entity_key) FILTER (WHERE {f} IS NOT NULL))[1] AS {f}" for f in MASTER_FIELDS)},
  count(*)::INT AS source_count, bool_or(entity_key IN (SELECT entity_key FROM pending)) AS has_pending_review
  FROM entities JOIN xref USING (entity_key) GROUP BY master_id)"""


def refined(select: str) -> str:
    """A statement about blocks with a limit that many of them exceed."""
    return "WITH RECURSIVE " + ",\n".join([SOURCE_ROWS, ENTITIES, blocks(4)]) + "\n" + select


def statement(select: str) -> str:
    chain = [SOURCE_ROWS, ENTITIES, BLOCKS, FEATURES, DECISIONS, SECOND_STAGE, CLUSTERS]
    if select.startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join([*chain, select.removeprefix("WITH ")])
    return "WITH RECURSIVE " + ",\n".join(chain) + "\n" + select


ENTITY_SELECT = ("SELECT entity_key, source, source_id, given_name, family_name, full_name_norm, family_soundex, email, "
                 "phone_e164, birth_date::VARCHAR AS birth_date, city, address, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM ")
PAIR_SELECT = (f"SELECT pair_id, left_key, right_key, email_agree, phone_agree, birth_agree, city_agree, {rounded('name_sim', 'name_sim')}, "
               f"{rounded('address_sim', 'address_sim')}, birth_date_conflict")
MASTER_SELECT = ("SELECT master_id, given_name, family_name, email, phone_e164, birth_date::VARCHAR AS birth_date, city, address, "
                 "source_count, has_pending_review FROM master")


def _check_rows(master: str) -> str:
    return f"""SELECT "check", CASE WHEN "check" = 'master not empty' THEN observed > 0 ELSE observed = 0 END AS passed, observed FROM (
  SELECT 'master_id not null' AS "check", count(*) FILTER (WHERE master_id IS NULL) AS observed FROM {master}
  UNION ALL SELECT 'given_name not null', count(*) FILTER (WHERE given_name IS NULL) FROM {master}
  UNION ALL SELECT 'family_name not null', count(*) FILTER (WHERE family_name IS NULL) FROM {master}
  UNION ALL SELECT 'master_id unique', count(master_id) - count(DISTINCT master_id) FROM {master}
  UNION ALL SELECT 'master not empty', count(*) FROM {master}
  UNION ALL SELECT 'email unique when resolved', count(email) FILTER (WHERE NOT has_pending_review)
    - count(DISTINCT email) FILTER (WHERE NOT has_pending_review) FROM {master}
  UNION ALL SELECT 'entity_key unique', count(*) - count(DISTINCT entity_key) FROM xref
  UNION ALL SELECT 'every entity mapped', (SELECT count(*) FROM entities WHERE entity_key NOT IN (SELECT entity_key FROM xref))
    + (SELECT count(*) FROM xref WHERE entity_key NOT IN (SELECT entity_key FROM entities)))"""


def _row_text(columns: tuple[str, ...]) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce('=' || {c}::VARCHAR, '-')" for c in columns) + ")"


def _digest(table: str, columns: tuple[str, ...]) -> str:
    return (f"SELECT count(*) AS rows, sum(h::HUGEINT)::VARCHAR AS hash_sum, bit_xor(h)::VARCHAR AS hash_xor FROM "
            f"(SELECT ('0x' || substr(md5({_row_text(columns)}), 1, 15))::BIGINT AS h FROM {table})")


_MASTER_DIGEST = _digest("master", ("master_id", *MASTER_FIELDS, "source_count", "has_pending_review"))
_XREF_DIGEST = _digest("xref", ("entity_key", "master_id"))


def _json(side: str) -> str:
    fields = [f"{f} := strftime({side}.updated_at, '%Y-%m-%dT%H:%M:%S.000Z')" if f == "updated_at" else f"{f} := {side}.{f}"
              for f in ENTITY_FIELDS]
    return f"to_json(struct_pack({', '.join(fields)}))::VARCHAR"


def _share(part: str, whole: str, name: str) -> str:
    return rounded(f"({part})::DOUBLE / nullif({whole}, 0)", name)


def _auc(rows: str) -> str:
    """Mann-Whitney: the rank sum of the positives, ties at their mean rank."""
    return f"""SELECT round((sum(mean_rank) FILTER (WHERE y) - n1 * (n1 + 1) / 2.0) / nullif(n1 * n0, 0), 6)::DOUBLE AS auc FROM (
  SELECT y, s, count(*) FILTER (WHERE y) OVER () AS n1, count(*) FILTER (WHERE NOT y) OVER () AS n0,
    rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS mean_rank FROM ({rows})) GROUP BY n1, n0"""


_CONFIGS = """SELECT config, count(*) AS n, count(*) FILTER (WHERE decision = 'MATCH') AS m, count(*) FILTER (WHERE decision = 'NON_MATCH') AS u,
  count(*) FILTER (WHERE decision = 'REVIEW') AS v, count(*) FILTER (WHERE decision = 'MATCH' AND is_match) AS tp,
  count(*) FILTER (WHERE decision = 'NON_MATCH' AND NOT is_match) AS tn FROM (
    SELECT 'rules' AS config, pair_id, decision FROM decided UNION ALL SELECT 'rules+score_overlap', pair_id, decision FROM overlay)
  JOIN labeled USING (pair_id) WHERE split = 'test' GROUP BY config"""
_TRUE_TEST = "(SELECT true_pairs FROM true_pairs WHERE split = 'test')"


def _violations(name: str, table: str, predicate: str) -> str:
    return f"SELECT '{name}' AS \"check\", count(*) FILTER (WHERE {predicate}) AS observed FROM {table}"


def _passed(parts: list[str]) -> str:
    return 'SELECT "check", observed = 0 AS passed, observed FROM (' + " UNION ALL ".join(parts) + ")"


_ORDER_CONTRACTS = _passed([
    _violations("orders.o_orderkey not null", "orders", "o_orderkey IS NULL"),
    _violations("orders.o_custkey not null", "orders", "o_custkey IS NULL"),
    _violations("orders.o_orderstatus allowed", "orders", "o_orderstatus NOT IN ('O', 'F')"),
    _violations("orders.o_totalprice range", "orders", "o_totalprice < 1000 OR o_totalprice > 400000"),
    "SELECT 'orders(o_orderkey) unique', count(o_orderkey) - count(DISTINCT o_orderkey) FROM orders",
    _violations("orders.o_custkey reference", "orders", "o_custkey NOT IN (SELECT c_custkey FROM customer)"),
    _violations("lineitem.l_orderkey not null", "lineitem", "l_orderkey IS NULL"),
    _violations("lineitem.l_quantity not null", "lineitem", "l_quantity IS NULL"),
    _violations("lineitem.l_returnflag allowed", "lineitem", "l_returnflag NOT IN ('A', 'N')"),
    _violations("lineitem.l_discount range", "lineitem", "l_discount < 0 OR l_discount > 0.05"),
    "SELECT 'lineitem(l_orderkey,l_linenumber) unique', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem",
    _violations("lineitem.l_orderkey reference", "lineitem", "l_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
    _violations("lineitem.l_partkey reference", "lineitem", "l_partkey NOT IN (SELECT p_partkey FROM part)"),
    _violations("lineitem.l_suppkey reference", "lineitem", "l_suppkey NOT IN (SELECT s_suppkey FROM supplier)"),
])


def _json_row(**columns: str) -> str:
    """JSON text of a row; a value in quotes is text, one without is a number."""
    parts = []
    for name, v in columns.items():
        value = f"'\"' || {v[1:]} || '\"'" if v[0] == '"' else f"({v})::VARCHAR"
        parts.append(f"'\"{name}\":' || coalesce({value}, 'null')")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _offenders(parts: list[str]) -> str:
    """Parts give (check, row)."""
    return f"""SELECT "check", offenders, "row" FROM (
  SELECT *, count(*) OVER (PARTITION BY "check") AS offenders, row_number() OVER (PARTITION BY "check" ORDER BY "row") AS n
  FROM ({' UNION ALL '.join(parts)}) AS found("check", "row")) WHERE n <= 100"""


def _rows_where(check: str, table: str, condition: str, row: str) -> str:
    return f"SELECT '{check}', {row} FROM {table} WHERE {condition}"


def _repeated(check: str, table: str, *keys: str, text: bool = False, where: str = "true") -> str:
    row = _json_row(**{k: ('"' if text else "") + k for k in keys}, rows="count(*)")
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"SELECT '{check}', {row} FROM {table} WHERE {where} AND {present} GROUP BY {', '.join(keys)} HAVING count(*) > 1"


def _orphans(check: str, table: str, key: str, parent: str, parent_key: str) -> str:
    return f"SELECT '{check}', {_json_row(**{key: key}, rows='count(*)')} FROM {table} WHERE {key} NOT IN (SELECT {parent_key} FROM {parent}) GROUP BY {key}"


_ORDER = _json_row(o_orderkey="o_orderkey", o_orderstatus='"o_orderstatus')
_ITEM = _json_row(l_orderkey="l_orderkey", l_linenumber="l_linenumber", l_returnflag='"l_returnflag')
_ORDER_OFFENDERS = _offenders([
    _rows_where("orders.o_orderkey not null", "orders", "o_orderkey IS NULL", _ORDER),
    _rows_where("orders.o_custkey not null", "orders", "o_custkey IS NULL", _ORDER),
    _rows_where("orders.o_orderstatus allowed", "orders", "o_orderstatus NOT IN ('O', 'F')", _ORDER),
    _rows_where("orders.o_totalprice range", "orders", "o_totalprice < 1000 OR o_totalprice > 400000", _ORDER),
    _repeated("orders(o_orderkey) unique", "orders", "o_orderkey"),
    _orphans("orders.o_custkey reference", "orders", "o_custkey", "customer", "c_custkey"),
    _rows_where("lineitem.l_orderkey not null", "lineitem", "l_orderkey IS NULL", _ITEM),
    _rows_where("lineitem.l_quantity not null", "lineitem", "l_quantity IS NULL", _ITEM),
    _rows_where("lineitem.l_returnflag allowed", "lineitem", "l_returnflag NOT IN ('A', 'N')", _ITEM),
    _rows_where("lineitem.l_discount range", "lineitem", "l_discount < 0 OR l_discount > 0.05", _ITEM),
    _repeated("lineitem(l_orderkey,l_linenumber) unique", "lineitem", "l_orderkey", "l_linenumber"),
    _orphans("lineitem.l_orderkey reference", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    _orphans("lineitem.l_partkey reference", "lineitem", "l_partkey", "part", "p_partkey"),
    _orphans("lineitem.l_suppkey reference", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
])
_DOUBLED = "(SELECT * FROM master UNION ALL SELECT * FROM master WHERE has_pending_review)"
_NAMES = _json_row(master_id='"master_id', given_name='"given_name', family_name='"family_name')
_GATE_OFFENDERS = _offenders([
    *[_rows_where(f"{c} not null", _DOUBLED, f"{c} IS NULL", _NAMES) for c in ("master_id", "given_name", "family_name")],
    _repeated("master_id unique", _DOUBLED, "master_id", text=True),
    _repeated("email unique when resolved", _DOUBLED, "email", text=True, where="NOT has_pending_review"),
    _repeated("entity_key unique", "xref", "entity_key", text=True),
    *[_rows_where("every entity mapped", a, f"entity_key NOT IN (SELECT entity_key FROM {b})", _json_row(entity_key='"entity_key', missing_in=f"\"'{b}'"))
      for a, b in (("entities", "xref"), ("xref", "entities"))],
])
_DECISION_CONTRACTS = _passed([
    _violations("decisions.pair_id not null", "decided", "pair_id IS NULL"),
    _violations("decisions.p_match not null", "decided", "p_match IS NULL"),
    _violations("decisions.decision not null", "decided", "decision IS NULL"),
    _violations("decisions.decision allowed", "decided", "decision NOT IN ('MATCH', 'NON_MATCH', 'REVIEW')"),
    _violations("decisions.p_match range", "decided", "p_match < 0 OR p_match > 1"),
    "SELECT 'decisions.p_same range', 0",
    "SELECT 'decisions columns', 0",
    "SELECT 'decisions(pair_id) unique', count(pair_id) - count(DISTINCT pair_id) FROM decided",
    _violations("decisions.pair_id reference", "decided", "pair_id NOT IN (SELECT pair_id FROM labeled)"),
])

_SILVER_CONTRACTS = _passed([
    _violations("entities.entity_key not null", "entities", "entity_key IS NULL"),
    _violations("entities.source not null", "entities", "source IS NULL"),
    _violations("entities.source_id not null", "entities", "source_id IS NULL"),
    _violations("entities.source allowed", "entities", "source NOT IN ('crm', 'billing')"),
    "SELECT 'entities columns', 0",
    "SELECT 'entities(entity_key) unique', count(entity_key) - count(DISTINCT entity_key) FROM entities",
    *[_violations(f"pairs.{c} not null", "decided", f"{c} IS NULL") for c in ("pair_id", "left_key", "right_key", "p_match", "decision")],
    _violations("pairs.decision allowed", "decided", "decision NOT IN ('MATCH', 'NON_MATCH', 'REVIEW')"),
    *[_violations(f"pairs.{c} range", "decided", f"{c} < 0 OR {c} > 1") for c in ("p_match", "name_sim", "address_sim")],
    "SELECT 'pairs columns', 0",
    "SELECT 'pairs(pair_id) unique', count(pair_id) - count(DISTINCT pair_id) FROM decided",
    "SELECT 'pairs(left_key,right_key) unique', count(*) - count(DISTINCT (left_key, right_key)) FROM decided",
    *[_violations(f"pairs.{c} reference", "decided", f"{c} NOT IN (SELECT entity_key FROM entities)") for c in ("left_key", "right_key")],
])


_EVEN = "right(of[left_key].person, 1)::INT % 2 = 0 AND right(of[right_key].person, 1)::INT % 2 = 0"


ORACLE: dict[str, str] = {name: statement(select) for name, select in {
    "source_rows": "SELECT src, id, person_id, given, family, email, phone, birth, address, city, r_case, updated_at FROM w",
    "ground_truth": "SELECT entity_key, true_entity_id, split FROM truth",
    "bronze_csv": "SELECT billing_id, full_name, email, phone, billing_address, city, updated_at FROM billing_users",
    "crm_entities": ENTITY_SELECT + "crm_entities",
    "billing_entities": ENTITY_SELECT + "billing_entities",
    "entities_all": ENTITY_SELECT + "entities",
    "block_sizes": "SELECT block, count(*) AS records FROM blocks GROUP BY block",
    "candidate_pairs": "SELECT left_key, right_key FROM candidates",
    "silver_contracts": _SILVER_CONTRACTS,
    "half_labeled_decisions": f"""WITH half AS MATERIALIZED (SELECT scored.* EXCLUDE (is_match, split),
  CASE WHEN {_EVEN} THEN is_match END AS is_match, CASE WHEN {_EVEN} THEN split END AS split FROM scored, known),
{_curve('half_curve', 'half')},
{_tuned('half_tuned', 'half_curve')}
SELECT pair_id, is_match, {rounded('p_match', 'p_match')}, {_route('half_tuned')} AS decision FROM half""",
    "failed_batches": """WITH small AS (SELECT pair_id, left_key, (row_number() OVER (ORDER BY pair_id) - 1) // 20 AS n FROM decided WHERE decision = 'REVIEW')
SELECT 'partial' AS checkpoint, 'b' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS batch_id, count(*) AS pairs,
  'ValueError: no model for this city' AS error FROM small JOIN entities ON entity_key = left_key GROUP BY n HAVING bool_or(city = 'nation 2')""",
    "gate_drill_same_run": "SELECT count(*) AS masters, true AS refused, true AS unchanged FROM master",
    "rerun_same_id": f"SELECT run_id, batch_id, checkpoint, pairs, load_s, {rounded('infer_s * 3', 'infer_s')} FROM timing",
    "pair_features": PAIR_SELECT + " FROM features",
    "pairs_filtered": PAIR_SELECT + " FROM pairs",
    "labeled_pairs": PAIR_SELECT + ", split, is_match FROM labeled",
    "split_assignment": "SELECT DISTINCT true_entity_id, split FROM truth",
    "true_pair_counts": "SELECT split, true_pairs FROM true_pairs",
    "blocking_recall": f"""SELECT found, true_pairs, {_share('found', 'true_pairs', 'recall')} FROM
  (SELECT count(*) FILTER (WHERE is_match) AS found FROM labeled), (SELECT sum(true_pairs)::BIGINT AS true_pairs FROM true_pairs)""",
    "rule_scores": f"SELECT pair_id, split, is_match, {rounded('p_match', 'p_match')} FROM scored",
    "threshold_curve": f"SELECT i, {rounded('t_high', 't_high')}, rows_high, hits_high, {rounded('t_low', 't_low')}, rows_low, hits_low FROM curve",
    "tuned_thresholds": f"SELECT {rounded('tau_high', 'tau_high')}, {rounded('tau_low', 'tau_low')} FROM tuned",
    "routed_decisions": f"SELECT pair_id, {rounded('p_match', 'p_match')}, decision FROM decided",
    "pair_update": f"SELECT pair_id, left_key, right_key, {rounded('p_match', 'p_match')}, decision FROM decided",
    "score_batches": "SELECT pair_id, batch_id FROM batches",
    "scored_queue": f"SELECT pair_id, batch_id, checkpoint, {rounded('p_same', 'p_same')} FROM scores",
    "cascade_overlay": f"SELECT pair_id, {rounded('p_match', 'p_match')}, decision FROM overlay",
    "review_queue": f"""SELECT pair_id, {rounded('p_match', 'p_match')}, birth_date_conflict, {_json('l')} AS left_record, {_json('r')} AS right_record
  FROM decided JOIN entities l ON l.entity_key = left_key JOIN entities r ON r.entity_key = right_key WHERE decision = 'REVIEW'""",
    "config_metrics": f"""SELECT config, n AS pairs_test, {_share('m', 'n', 'pct_match')}, {_share('u', 'n', 'pct_non_match')},
  {_share('v', 'n', 'pct_review')}, {_share('tp', 'm', 'precision_match')}, {_share('tn', 'u', 'npv_non_match')},
  {_share('tp', _TRUE_TEST, 'recall_auto')}, {_share('m + u', 'n', 'automation')} FROM ({_CONFIGS})""",
    "cascade_metrics": f"""SELECT queue, queue_true_matches, resolved, {_share('resolved', 'queue', 'resolved_pct')}, resolved_match, resolved_non_match,
  resolved - good AS errors, {_share('good', 'resolved', 'precision_resolved')}, judged AS pairs_judged_all_splits,
  {rounded('seconds', 'score_seconds')}, {_share('seconds', 'judged', 'score_s_per_pair')} FROM (
  SELECT count(*) AS queue, count(*) FILTER (WHERE is_match) AS queue_true_matches, count(*) FILTER (WHERE o.decision <> 'REVIEW') AS resolved,
    count(*) FILTER (WHERE o.decision = 'MATCH') AS resolved_match, count(*) FILTER (WHERE o.decision = 'NON_MATCH') AS resolved_non_match,
    count(*) FILTER (WHERE (o.decision = 'MATCH' AND is_match) OR (o.decision = 'NON_MATCH' AND NOT is_match)) AS good
  FROM decided d JOIN overlay o USING (pair_id) WHERE d.split = 'test' AND d.decision = 'REVIEW'),
  (SELECT sum(pairs)::BIGINT AS judged, sum(load_s + infer_s) AS seconds FROM timing)""",
    "score_metrics": f"""SELECT checkpoint, batches, {rounded('p50', 'p50_batch_s')}, {rounded('load_s', 'load_s_avg')}, {rounded('infer_s', 'infer_s_total')},
  {_share('pairs', 'infer_s', 'pairs_per_s')}, {_share('1000 * infer_s', 'pairs', 'sec_per_1k')},
  {_share('1000 * infer_s / 3600 * 0.30', 'pairs', 'usd_per_1k')}, a.auc AS auc_test,
  (SELECT count(*) FROM scores WHERE p_same IS NULL) AS invalid FROM (
    SELECT checkpoint, count(*) AS batches, quantile_cont(infer_s, 0.5) AS p50, avg(load_s) AS load_s, sum(infer_s) AS infer_s, sum(pairs) AS pairs
    FROM timing GROUP BY checkpoint),
  ({_auc("SELECT is_match AS y, p_same AS s FROM scores JOIN labeled USING (pair_id) WHERE split = 'test'")}) a""",
    "auc_by_rules": _auc("SELECT is_match AS y, p_match AS s FROM scored WHERE split = 'test'"),
    "cluster_roots": "SELECT entity_key, root_key FROM roots",
    "master_ids": "SELECT entity_key, master_id FROM xref",
    "golden_records": MASTER_SELECT,
    "updated_masters": MASTER_SELECT,
    "updated_clusters": f"""WITH early AS MATERIALIZED (SELECT entity_key FROM entities WHERE md5(entity_key) >= '4'),
early_pairs AS MATERIALIZED (SELECT left_key AS a, right_key AS b FROM decided WHERE decision = 'MATCH' AND pair_id < '8'
  AND left_key IN (SELECT entity_key FROM early) AND right_key IN (SELECT entity_key FROM early)),
early_links AS MATERIALIZED (SELECT a, b FROM early_pairs UNION SELECT b, a FROM early_pairs),
early_reached(entity_key, other) AS (SELECT entity_key, entity_key FROM early UNION SELECT r.entity_key, l.b FROM early_reached r JOIN early_links l ON l.a = r.other),
early_xref AS (SELECT entity_key, {uuid5('root_key')} AS was FROM (SELECT entity_key, min(other) AS root_key FROM early_reached GROUP BY entity_key))
SELECT 'member' AS kind, entity_key AS key, master_id FROM xref
UNION ALL SELECT DISTINCT 'redirect', was, master_id FROM early_xref JOIN xref USING (entity_key) WHERE was <> master_id""",
    "published_gold": MASTER_SELECT,
    "pending_review": "SELECT entity_key FROM pending",
    "quality_checks": _check_rows("master"),
    "gate_offenders": _GATE_OFFENDERS,
    "resumed_scores": f"""WITH small AS (SELECT pair_id, left_key, (row_number() OVER (ORDER BY pair_id) - 1) // 20 AS n FROM decided WHERE decision = 'REVIEW'),
failed AS (SELECT n FROM small JOIN entities ON entity_key = left_key GROUP BY n HAVING bool_or(city = 'nation 2'))
SELECT pair_id, 'b' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS batch_id, 'resumed' AS checkpoint,
  {rounded('CASE WHEN n IN (SELECT n FROM failed) THEN p_same ELSE 0.5 END', 'p_same')} FROM small JOIN scores USING (pair_id)""",
    "gate_drill": _check_rows("(SELECT * FROM master UNION ALL (SELECT * FROM master ORDER BY master_id LIMIT 1))"),
    "decision_contracts": _DECISION_CONTRACTS,
    "gold_digest": f"SELECT 'customer_master' AS \"table\", * FROM ({_MASTER_DIGEST}) UNION ALL SELECT 'customer_xref', * FROM ({_XREF_DIGEST})",
    "idempotence": f"""SELECT md5((SELECT concat_ws(':', rows, hash_sum, hash_xor) FROM ({_MASTER_DIGEST})) || '|' ||
  (SELECT concat_ws(':', rows, hash_sum, hash_xor) FROM ({_XREF_DIGEST}))) AS stored, true AS identical""",
    "upsert_scores": f"""SELECT pair_id, 'overlap' AS checkpoint, {rounded('CASE WHEN s.pair_id IS NULL THEN p_match ELSE p_same END', 'p_same')}
  FROM decided LEFT JOIN scores s USING (pair_id)""",
    "upsert_timing": f"SELECT run_id, batch_id, checkpoint, pairs, 1.0::DOUBLE AS load_s, {rounded('infer_s * 2', 'infer_s')} FROM timing",
    "volume_counts": """SELECT 'entities' AS metric, count(*) AS value FROM entities UNION ALL SELECT 'candidates', count(*) FROM decided
  UNION ALL SELECT 'masters', count(*) FROM master UNION ALL SELECT 'pending_masters', count(*) FILTER (WHERE has_pending_review) FROM master""",
}.items()}

ORACLE |= {
    "ragged_csv": """SELECT CASE WHEN short OR long THEN 'quarantined' ELSE 'kept' END AS kind,
  CASE WHEN short THEN '"' || k || '","' || n || '"' WHEN long THEN '"' || k || '","' || n || '","' || m || '","' || k || '"'
    ELSE k || '|' || n || '|' || m END AS record
  FROM (SELECT coalesce(c_custkey::VARCHAR, '') AS k, coalesce(c_name, '') AS n, coalesce(c_mktsegment, '') AS m,
    coalesce(c_custkey % 7 = 3, false) AS short, coalesce(c_custkey % 11 = 5, false) AS long FROM customer)""",
    "document_words": f"SELECT doc_id, length(words) AS n_chars, md5(words) AS digest FROM (SELECT doc_id, {norm_text('text')} AS words FROM documents)",
    "auc_by_length": _auc("SELECT quality = 1 AS y, n_chars AS s FROM documents JOIN labels USING (doc_id)"),
    "auc_by_source": """SELECT source, round((sum(mean_rank) FILTER (WHERE y) - n1 * (n1 + 1) / 2.0) / nullif(n1 * n0, 0), 6)::DOUBLE AS auc FROM (
  SELECT source, y, count(*) FILTER (WHERE y) OVER (PARTITION BY source) AS n1, count(*) FILTER (WHERE NOT y) OVER (PARTITION BY source) AS n0,
    rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2.0 AS mean_rank
  FROM (SELECT source, quality = 1 AS y, n_chars AS s FROM documents JOIN labels USING (doc_id))) GROUP BY source, n1, n0""",
    "order_contracts": _ORDER_CONTRACTS,
    "order_offenders": _ORDER_OFFENDERS,
    "event_survivors": """SELECT user_id, (list(event_type ORDER BY ts DESC, event_id) FILTER (WHERE event_type <> 'error'))[1] AS event_type,
  (list(round(value, 6) ORDER BY ts DESC, event_id) FILTER (WHERE value >= 10))[1] AS value,
  (list(props->>'k' ORDER BY ts DESC, event_id) FILTER (WHERE props->>'k' IS NOT NULL))[1] AS k, count(*) AS events FROM events GROUP BY user_id""",
    "upsert_events": """SELECT user_id, event_type, event_id, round(value, 6) AS value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
}
ORACLE |= {
    "refined_pairs": refined("SELECT DISTINCT left_key, right_key FROM met WHERE level > 0"),
    "oversized_blocks": refined("""SELECT block, records, pairs FROM (
  SELECT b.block, b.records, b.records * (b.records - 1) // 2 - coalesce(f.formed, 0)::BIGINT AS pairs
  FROM (SELECT block, count(*) AS records FROM blocks GROUP BY block HAVING count(*) > 4) AS b
  LEFT JOIN (SELECT origin AS block, sum(len(members) * (len(members) - 1) // 2) AS formed FROM grouped GROUP BY origin) AS f USING (block)) WHERE pairs > 0"""),
}

_MENTIONS = r"""WITH RECURSIVE texts AS (SELECT 'doc:' || doc_id AS entity_key, text FROM documents UNION ALL SELECT 'page:' || page_id, html FROM pages),
found AS MATERIALIZED (
  SELECT DISTINCT entity_key, 'e:' || lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}'))) AS key FROM texts WHERE entity_key IS NOT NULL
  UNION SELECT entity_key, 'p:' || regexp_replace(unnest(regexp_extract_all(text, '[+][0-9][0-9 ().-]{7,}[0-9]')), '[^0-9]', '', 'g') FROM texts WHERE entity_key IS NOT NULL),
keys AS MATERIALIZED (SELECT key, count(*) AS records, log2((SELECT count(*) FROM texts)::DOUBLE / count(*)) AS weight, count(*) > 50 AS hub FROM found GROUP BY key),
links AS MATERIALIZED (SELECT a.entity_key AS x, b.entity_key AS y FROM found AS a JOIN found AS b USING (key) JOIN keys USING (key)
  WHERE NOT hub AND a.entity_key <> b.entity_key GROUP BY ALL HAVING round(sum(weight), 6) >= 4),
reached AS (SELECT DISTINCT entity_key, entity_key AS other FROM found UNION SELECT r.entity_key, l.y FROM reached AS r JOIN links AS l ON l.x = r.other),
rooted AS (SELECT entity_key, min(other) AS root_key FROM reached GROUP BY entity_key)
"""
ORACLE |= {
    "mention_keys": _MENTIONS + "SELECT key, records, round(weight, 6) AS weight, hub FROM keys",
    "mention_clusters": _MENTIONS + "SELECT entity_key, root_key FROM rooted",
    "mention_survivors": _MENTIONS + """, counted AS (SELECT root_key, key, count(*) AS n FROM found JOIN rooted USING (entity_key) GROUP BY ALL)
SELECT root_key, records, substr((SELECT key FROM counted AS c WHERE c.root_key = s.root_key AND key LIKE 'e:%' ORDER BY n DESC, key LIMIT 1), 3) AS email,
  substr((SELECT key FROM counted AS c WHERE c.root_key = s.root_key AND key LIKE 'p:%' ORDER BY n DESC, key LIMIT 1), 3) AS phone
FROM (SELECT root_key, count(*) AS records FROM rooted GROUP BY root_key HAVING count(*) > 1) AS s""".lstrip(),
    "similar_names": "WITH RECURSIVE " + SOURCE_ROWS + ",\n" + ENTITIES + """,
names AS MATERIALIZED (SELECT DISTINCT city AS block, list_sort(list_distinct(string_split(full_name_norm, ' '))) AS t FROM entities WHERE city IS NOT NULL AND full_name_norm IS NOT NULL),
compared AS (SELECT a.block, a.t AS x, b.t AS y, len(list_intersect(a.t, b.t)) AS shared FROM names AS a JOIN names AS b ON a.block = b.block AND a.t < b.t)
SELECT block, array_to_string(x, ' ') AS left_tokens, array_to_string(y, ' ') AS right_tokens, shared, len(x) + len(y) - shared AS total
FROM compared WHERE 100 * shared >= 60 * (len(x) + len(y) - shared)""",
}


def _design(score: str | None = None) -> list[str]:
    agreements = [f"({c} = {v})::INT::DOUBLE" for c in ("email_agree", "phone_agree", "birth_agree", "city_agree") for v in (1, -1)]
    return [*agreements, "name_sim", "address_sim", *([f"coalesce({score}, 0.5::DOUBLE)"] if score else []), "1.0::DOUBLE"]


def _margin(columns: list[str]) -> str:
    return " + ".join(f"w[{i}] * {c}" for i, c in enumerate(columns, 1))


def _fitted(name: str, train: str, score: str | None = None) -> str:
    """Penalised Newton steps from zero in a recursive table; every step's system is solved by elimination without pivots."""
    design = _design(score)
    k, x = len(design), [f"x{i}" for i in range(1, len(design) + 1)]
    rows = ", ".join("[" + ", ".join([*[
        f"sum(n * p * (1 - p) * {x[min(i, j)]} * {x[max(i, j)]}) + {1.0 if i == j < k - 1 else 1e-12 if i == j else 0.0}::DOUBLE" for j in range(k)],
        f"sum((n * p - hits) * {x[i]}) + {1.0 if i < k - 1 else 0.0}::DOUBLE * w[{i + 1}]"]) + "]" for i in range(k))
    solved = (f"SELECT step, w, [{rows}] AS m FROM (SELECT step, w, n, hits, {', '.join(x)}, 1 / (1 + exp(-({_margin(x)}))) AS p "
              f"FROM {name}_steps, {name}_rows WHERE step < 15) GROUP BY step, w")
    for i in range(1, k + 1):
        solved = (f"SELECT step, w, list_transform(m, lambda r, i: CASE WHEN i = {i} THEN list_transform(r, lambda v: v / m[{i}][{i}]) "
                  f"ELSE list_transform(r, lambda v, j: v - r[{i}] * m[{i}][j] / m[{i}][{i}]) END) AS m FROM ({solved})")
    return f"""{name}_rows AS MATERIALIZED (SELECT {', '.join(x)}, count(*)::DOUBLE AS n, count(*) FILTER (WHERE is_match)::DOUBLE AS hits FROM (
  SELECT is_match, {', '.join(f'{d} AS {c}' for d, c in zip(design, x))} FROM {train} WHERE split = 'dev') GROUP BY {', '.join(x)}),
{name}_steps(step, w) AS (SELECT 0, [{', '.join(['0.0::DOUBLE'] * k)}] UNION ALL
  SELECT step + 1, list_transform(w, lambda v, i: v - m[i][{k + 1}]) FROM ({solved})),
{name} AS MATERIALIZED (SELECT w FROM {name}_steps ORDER BY step DESC LIMIT 1)"""


FITTED_DECISIONS = DECISIONS.replace(
    f"scored AS MATERIALIZED (SELECT *, {RULES} AS p_match FROM labeled)",
    f"{_fitted('rules_fit', 'labeled')},\nscored AS MATERIALIZED (SELECT labeled.*, 1 / (1 + exp(-({_margin(_design())}))) AS p_match FROM labeled, rules_fit)")
FITTED_SECOND = SECOND_STAGE.replace(
    f"queue_scored AS MATERIALIZED (SELECT *, {SECOND} AS p_match FROM queue)",
    f"{_fitted('second_fit', 'queue', 'p_same')},\nqueue_scored AS MATERIALIZED (SELECT queue.*, 1 / (1 + exp(-({_margin(_design('p_same'))}))) AS p_match FROM queue, second_fit)"
).replace("AS decision FROM queue_scored)", "AS decision FROM queue_scored WHERE (SELECT count(DISTINCT is_match) FROM queue WHERE split = 'dev') = 2)")
_FINAL = "final AS MATERIALIZED (SELECT d.left_key, d.right_key, o.decision FROM decided d JOIN overlay o USING (pair_id))"


def _chained(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([SOURCE_ROWS, ENTITIES, BLOCKS, FEATURES, *parts]) + "\n"


ORACLE |= {
    "rules_stage": _chained(FITTED_DECISIONS) + f"SELECT pair_id, NULL::DOUBLE AS p_same, {rounded('p_match', 'p_match')}, decision FROM decided",
    "cascade_fitted": _chained(DECISIONS, FITTED_SECOND) + f"SELECT pair_id, NULL::DOUBLE AS p_same, {rounded('p_match', 'p_match')}, decision FROM overlay",
    "linked_customers": _chained(FITTED_DECISIONS, CLUSTERS) + MASTER_SELECT,
    "linked_customers_cascade": _chained(FITTED_DECISIONS, FITTED_SECOND, _FINAL, CLUSTERS.replace("FROM decided", "FROM final")) + MASTER_SELECT,
}
