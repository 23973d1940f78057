"""SQL for the registered queries of this subpackage, where SQL can express them."""

from __future__ import annotations

from placelens.llm import chat, importance
from placelens.llm.mixing import CURRICULUM, Schedule, integral
from placelens.llm.queries import URL_RULES
from placelens.llm.secrets import BASE_RULES, RULES, SecretRule
from placelens.llm.urls import SOFT_LIMIT, SOFT_TERMS, STRICT_TERMS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_sql() -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r.text))
    fits = {
        r.text: f"((host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)}))"
        for r in rules
    }
    rule = " ".join(f"WHEN {fits[r.text]} THEN {quoted(r.text)}" for r in rules)
    verdict = " ".join(f"WHEN rule = {quoted(r.text)} THEN {quoted(r.verdict)}" for r in rules)

    def found(term: str) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"

    strict = " + ".join(f"{found(t)}::INT" for t in STRICT_TERMS)
    soft = " + ".join(f"{found(t)}::INT" for t in SOFT_TERMS)
    weight = " + ".join(f"{found(t)}::INT * {w!r}::DOUBLE" for t, w in SOFT_TERMS.items())
    return f"""
    WITH split AS (
        SELECT page_id,
            coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
            coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS low
        FROM pages
    ), judged AS (
        SELECT *, CASE {rule} END AS rule, ({strict}) AS strict_hits, ({soft}) AS soft_hits, ({weight}) AS soft_weight
        FROM split
    )
    SELECT page_id, host, path, rule, strict_hits, soft_hits, soft_weight,
        CASE {verdict} WHEN strict_hits > 0 OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
    FROM judged
    """


def time_sql(schedule: Schedule, share: str) -> str:
    whole, ahead, parts = integral(schedule), 0.0, []
    for (a, v), (b, w) in zip(schedule, schedule[1:], strict=False):
        slope = (w - v) / (b - a)
        rest = f"greatest({share} * {whole!r}::DOUBLE - {ahead!r}::DOUBLE, 0)"
        below = f"({v!r}::DOUBLE + sqrt(greatest({v * v!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0)))"
        inside = f"least(CASE WHEN {below} > 0 THEN 2 * {rest} / {below} ELSE 0 END, {b - a!r}::DOUBLE)"
        ahead += (b - a) * (v + w) / 2
        parts.append(f"WHEN {share} * {whole!r}::DOUBLE < {ahead!r}::DOUBLE THEN {a!r}::DOUBLE + {inside}")
    return f"CASE {' '.join(parts)} ELSE 1.0::DOUBLE END"


def mix_sql() -> str:
    n = len(CURRICULUM)
    weight = " ".join(f"WHEN {i} THEN {integral(s)!r}::DOUBLE" for i, s in enumerate(CURRICULUM))
    position = " ".join(f"WHEN {i} THEN {time_sql(s, 'share')}" for i, s in enumerate(CURRICULUM))
    return f"""
    WITH docs AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
            ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 15))::BIGINT AS key
        FROM documents
    ), sums AS (
        SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} AS turn
        FROM docs GROUP BY source
    ), sources AS (
        SELECT *, CASE turn {weight} END AS weight FROM sums
    ), filled AS (
        SELECT 3 * source_size / weight AS room,
            sum(3 * source_size) OVER upward AS held, sum(weight) OVER () - sum(weight) OVER upward AS weights,
            row_number() OVER upward AS k, sum(source_size) OVER () AS total
        FROM sources WINDOW upward AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
    ), levels AS (
        SELECT 0 AS k, any_value(total)::DOUBLE / (SELECT sum(weight) FROM sources) AS level, min(room) AS room FROM filled
        UNION ALL
        SELECT k, (total - held)::DOUBLE / weights, lead(room) OVER (ORDER BY k) FROM filled WHERE weights > 0
    ), chosen AS (
        SELECT level FROM levels WHERE level <= room OR room IS NULL ORDER BY k LIMIT 1
    ), targets AS (
        SELECT source, source_size, turn, least(weight * level, 3.0::DOUBLE * source_size) AS target FROM sources, chosen
    ), placed AS (
        SELECT doc_id, size, source_size, target, turn, coalesce(sum(size) OVER (
            PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    ), passed AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS passes FROM placed
    ), used AS (
        SELECT *, greatest(least(floor(target)::BIGINT - passes * source_size - before, size), 0) AS final,
            before / target AS share
        FROM passed
    )
    SELECT doc_id, size, source_size, target, passes * size + final AS taken,
        (passes + (final > 0)::INT)::INT AS n_uses,
        CASE WHEN passes > 0 OR final > 0 THEN round(CASE turn {position} END, 9) END AS first_position
    FROM used
    """


def sql_pattern(rule: SecretRule) -> str:
    """The rule's pattern with both cases of each keyword letter spelled out, for a matcher that never goes back."""
    pattern = rule.pattern.replace("++", "+")
    head, mark, tail = pattern.partition("(?i:")
    if not mark:
        return pattern
    inner, _, rest = tail.partition(")")
    both = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in inner)
    return f"{head}(?:{both}){rest}"


def secret_sql() -> str:
    columns, lists = [], []
    for i, rule in enumerate(RULES):
        pattern, before = quoted(sql_pattern(rule)), f"[^{rule.inside}]"
        # Where a match must not begin inside a run, the character before it is matched too, and taken off.
        whole = quoted(f"(?:^|{before}){sql_pattern(rule)}") if rule.inside else pattern
        columns.append(f"regexp_extract_all(body, {whole}) AS m{i}, string_split_regex(body, {whole}) AS s{i}")
        value = f"regexp_extract(m{i}[i], {pattern}, {rule.group})"
        extra = f"length(m{i}[i]) - length({value})" if rule.inside else "0"
        start = f"{extra} + list_sum(list_transform(s{i}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{i}[1:i - 1], lambda x: length(x))), 0)"
        lists.append(
            f"list_filter(list_transform(range(1, len(m{i}) + 1), lambda i: {{'start': {start}, 'rule': {i}, "
            f"'kind': {quoted(rule.kind)}, 'size': length(m{i}[i]) - ({extra}), 'valid': length({value}) >= {rule.least}}}), lambda x: x.valid)"
        )
    joined = "array_to_string(list_transform({0}, lambda x: x.kind || ':' || x.start::BIGINT || ':' || (x.start + x.size)::BIGINT), ',')"
    base = f"list_filter(spans, lambda x: x.rule < {len(BASE_RULES)})"
    counts = ", ".join(f"len(list_filter(spans, lambda x: x.rule = {i}))::BIGINT AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
    matched AS (SELECT doc_id, {", ".join(columns)} FROM texts),
    found AS (SELECT doc_id, list_sort(flatten([{", ".join(lists)}])) AS spans FROM matched)
    SELECT doc_id, {counts}, sha256(coalesce({joined.format(base)}, '')) AS base_sha256,
        coalesce({joined.format("spans")}, '') AS spans
    FROM found
    """


# One row with the 256 remainders of a byte-wise CRC-32; its polynomial is a fixed value.
CRC_TABLE = """crc_table AS (
        SELECT list(crc ORDER BY i) AS crcs FROM (
            SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc
            FROM range(256) t(i)
        )
    )"""


def crc_sql(text: str) -> str:
    """CRC-32 of a text of a table that is joined to CRC_TABLE."""
    data = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    step = "lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), {step}), 4294967295)"


def merkle_sql() -> str:
    fields = ["doc_id", "source", "lang", "n_chars"]

    def digest(values: list[str]) -> str:
        parts = [f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values]
        return f"sha256({' || '.join(parts)})"

    def parents(name: str) -> str:
        return f"""SELECT tree, lvl + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
        FROM {name} WHERE n > 1 GROUP BY tree, lvl, idx // 3"""

    return f"""
    WITH RECURSIVE {CRC_TABLE}, hashed AS (
        SELECT doc_id, coalesce('=' || source, '') AS tree, {digest([*fields, "text"])} AS leaf,
            CASE WHEN {crc_sql("doc_id::VARCHAR")} % 2 = 0 THEN {digest([*fields, "replace(text, chr(10), '')"])} END AS tampered
        FROM documents, crc_table
    ), leaves AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
            count(*) OVER (PARTITION BY tree) AS n
        FROM hashed
    ), low(tree, lvl, idx, n, digest) AS (
        SELECT tree, 0, idx, n, leaf FROM leaves UNION ALL {parents("low")}
    ), subroots AS (
        SELECT tree, lvl, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1
    ), high(tree, lvl, idx, n, digest) AS (
        SELECT '#', 0, idx, n, digest FROM subroots UNION ALL {parents("high")}
    ), nodes AS (SELECT * FROM low UNION ALL SELECT * FROM high),
    moves AS (
        SELECT a.tree, a.lvl, a.idx, a.tree AS to_tree, a.lvl + 1 AS to_lvl, a.idx // 3 AS to_idx, true AS up,
            coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
            coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
        FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3
        WHERE a.n > 1 GROUP BY ALL
        UNION ALL
        SELECT tree, lvl, 0, '#', 0, idx, false, '', '' FROM subroots
    ), walk(doc_id, leaf, home, tree, lvl, idx, proof, now) AS (
        SELECT doc_id, leaf, tree, tree, 0, idx, '', coalesce(tampered, leaf) FROM leaves
        UNION ALL
        SELECT doc_id, leaf, home, to_tree, to_lvl, to_idx, proof || before || after,
            CASE WHEN up THEN sha256(before || now || after) ELSE now END
        FROM walk JOIN moves USING (tree, lvl, idx)
    )
    SELECT doc_id, leaf, s.digest AS subroot, h.digest AS root, sha256(proof) AS proof_sha256, now AS folded_root,
        now = h.digest AS verified
    FROM walk w JOIN high h ON w.tree = '#' AND w.lvl = h.lvl AND h.n = 1 JOIN subroots s ON s.tree = w.home
    """


def resampling_sql() -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{pattern}')) AS word"
    buckets = importance.BUCKETS
    return f"""
    WITH {CRC_TABLE}, doc_words AS (SELECT doc_id, {words} FROM documents),
    target_words AS (SELECT {words} FROM benchmark),
    hashed AS (
        SELECT word, {crc_sql("word")} % {buckets} AS bucket
        FROM (SELECT word FROM doc_words UNION SELECT word FROM target_words), crc_table
    ), raw AS (SELECT bucket, count(*) AS s FROM doc_words JOIN hashed USING (word) GROUP BY bucket),
    target AS (SELECT bucket, count(*) AS t FROM target_words JOIN hashed USING (word) GROUP BY bucket),
    gains AS (
        SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM doc_words) + {buckets})
            / ((s + 1)::DOUBLE * ((SELECT count(*) FROM target_words) + {buckets}))))::BIGINT AS gain
        FROM raw LEFT JOIN target USING (bucket)
    ), weighed AS (
        SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
        FROM doc_words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
    ), noisy AS (
        SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
            floor(-1000 * ln(-ln((('0x' || left(sha256('{importance.SEED}:' || d.doc_id), 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS noise
        FROM documents d LEFT JOIN weighed w ON d.doc_id = w.doc_id
    ), placed AS (
        SELECT *, weight + noise AS score, n_features >= {importance.LEAST_WORDS} AS able,
            row_number() OVER (PARTITION BY n_features >= {importance.LEAST_WORDS} ORDER BY weight + noise DESC, doc_id) AS place,
            count(*) OVER (PARTITION BY n_features >= {importance.LEAST_WORDS}) AS n
        FROM noisy
    )
    SELECT doc_id, n_features, weight, score,
        CASE WHEN able AND place <= {importance.PERCENT} * n // 100 THEN place::BIGINT END AS rank
    FROM placed
    """


def chat_sql() -> str:
    template = chat.BRACKETS
    pattern = quoted(chat.control_pattern(template, r"\\*"))
    escape = lambda text: f"regexp_replace({text}, {pattern}, '\\1\\\\\\2\\3', 'g')"
    marks = " ".join(f"WHEN {quoted(role)} THEN {len(m.head + m.tail)}" for role, m in template.roles.items())
    other = f"{len(template.other.head + template.named + template.other.tail)} + length({escape('role')})"
    learned = ", ".join(quoted(role) for role, m in template.roles.items() if m.learned)
    states = " ".join(f"WHEN {quoted(role)} THEN {quoted(state)}" for role, state in template.recover.items())
    steps = ", ".join(f"({quoted(a)}, {quoted(role)})" for a, step in template.follows.items() for role in step)
    order = "ORDER BY turn NULLS FIRST, role, body"
    return f"""
    WITH chats AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
        UNION ALL
        SELECT -7, i, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(i, role)
    ), stated AS (SELECT *, CASE role {states} ELSE '{chat.ERROR}' END AS state FROM chats),
    stepped AS (
        SELECT *, (coalesce(lag(state) OVER (PARTITION BY conv_id {order}), '{chat.START}'), role) IN ({steps}) AS legal FROM stated
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || body || chr(10), '' {order})) AS turns_sha256,
        coalesce(sum(length(body)) FILTER (role IN ({learned})), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(body, '' {order}) FILTER (role IN ({learned})), '')) AS loss_sha256,
        sum(length({escape("body")}) + CASE role {marks} ELSE {other} END)::BIGINT AS formatted_chars,
        bool_and(legal) AS in_order, last(state {order}) AS end_state
    FROM stepped GROUP BY conv_id
    """


LLM_ORACLE: dict[str, str] = {
    "op1_url_filter": url_sql(),
    "op2_source_mix": mix_sql(),
    "op5_secret_scan": secret_sql(),
    "op11_merkle_manifest": merkle_sql(),
    "op12_target_resampling": resampling_sql(),
    "op13_chat_format": chat_sql(),
}
