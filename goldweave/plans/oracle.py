"""The engine's tables as common table expressions for DuckDB, written on their own: what the queries are held against."""

from __future__ import annotations

from ..sources.fixtures import EVENTS, RAW, RECORDS


def initcap(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1:1]) || lower(w[2:])), '')"


def soundex(x: str) -> str:
    """Of ASCII names that start with a letter."""
    codes = f"translate(upper({x})[1:1]||regexp_replace(substr(upper({x}),2),'[HW]','','g'),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','01230127022455012623017202')"
    codes = f"regexp_replace({codes},'[^0-9]','0','g')"
    for d in "123456":
        codes = f"regexp_replace({codes},'{d}+','{d}','g')"
    return f"(upper({x})[1:1] || rpad(left(replace(substr({codes},2),'0',''),3),3,'0'))"


def domain(x: str) -> str:
    return f"case when instr({x}, '@') > 0 then substr({x}, instr({x}, '@')) end"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def suffix(x: str, n: int = 4) -> str:
    return f"case when length({digits(x)}) >= {n} then right({digits(x)}, {n}) end"


def last_words(x: str) -> str:
    return f"case when instr({x}, ' ') > 0 then trim(substr({x}, instr({x}, ' ') + 1)) end"


_FILE = "try_cast(split_part(_source_file, '_crm_', 1) as date)"


def _clean(x: str, system: str) -> str:
    tokens = "'', 'NULL', 'null'" + (", 'N/A'" if system == "c" else "")
    return f"case when {x} not in ({tokens}) then {x} end"


def _customer(system: str, key: str, first: str, last: str, email: str, phone: str) -> str:
    return f"""select 'CRM_{system.upper()}' source_system, {key} source_key, {initcap(first)} first_name, {initcap(last)} last_name,
  lower(trim({_clean(email, system)})) email, regexp_replace({_clean(phone, system)}, '[^0-9+]', '', 'g') phone, {_FILE} file_date from raw_{system}"""


def _address(system: str, key: str, customer: str, street: str, city: str, postal: str, country: str) -> str:
    street, city = (initcap(f"trim({_clean(c, system)})") for c in (street, city))
    postal, country = (f"upper(trim({_clean(c, system)}))" for c in (postal, country))
    return f"select 'CRM_{system.upper()}' source_system, {key} source_key, {customer} source_customer_key, {street} street, {city} city, {postal} postal_code, {country} country, {_FILE} file_date from addr_{system}"


_A, _B, _C = (_clean(n, s) for n, s in (("first_name", "a"), ("name", "b"), ("caller_name", "c")))
# Fixed values, written here again so that the lists of the engine are held against them.
_LIST = "'Test User', 'Asdf Qwerty'"
_NICK = "when 'Bill' then 'William' when 'Bob' then 'Robert' when 'Liz' then 'Elizabeth' when 'Mike' then 'Michael' when 'Dick' then 'Richard' when 'Jim' then 'James' when 'Peggy' then 'Margaret' when 'Chuck' then 'Charles' when 'Ted' then 'Theodore'"
_TIDY = initcap("trim(first_name)")
_AI = f"""select *, case when length(trim(first_name)) > 1 then {initcap(f"trim(case {_TIDY} {_NICK} else {_TIDY} end)")} else first_name end canonical_first_name,
  case when length(trim(first_name)) > 0 and length(trim(last_name)) > 0 then {initcap("trim(first_name) || ' ' || trim(last_name)")} in ({_LIST}) else false end is_fake_name from customer_union"""
_FUZZY = f"select *, {_TIDY} canonical_first_name, false is_fake_name from customer_union"
_BLOCKS = f"{soundex('last_name')} block_soundex, {domain('email')} block_email_domain, {suffix('phone')} block_phone_suffix"
_PAIR = """a.source_system source_a, a.source_key key_a, b.source_system source_b, b.source_key key_b"""
_FIELDS = ("canonical_first_name", "last_name", "email", "phone", "street", "city", "postal_code", "block_soundex", "block_email_domain", "block_phone_suffix")
_SIDES = ", ".join(f"{s}.{c} {c}_{s}" for s in "ab" for c in _FIELDS)
_BLOCKED = """(a.block_soundex = b.block_soundex or a.block_email_domain = b.block_email_domain or a.block_phone_suffix = b.block_phone_suffix)"""


def _pairs(base: str) -> str:
    return f"select distinct {_PAIR}, {_SIDES} from {base} a join {base} b on (a.source_system, a.source_key) < (b.source_system, b.source_key) and {_BLOCKED}"


def _scores(pairs: str, mode: str) -> str:
    full = lambda s: f"canonical_first_name_{s} || ' ' || last_name_{s}"
    bulk = mode == "bulk"
    cent = (lambda x: f"round({x}, 2)") if bulk else (lambda x: x)
    jw = lambda a, b: cent(f"jaro_winkler_similarity({a}, {b})")
    tidy = (lambda x: f"lower(trim({x}))") if bulk else (lambda x: f"lower({x})")
    ten = (lambda x: x) if bulk else (lambda x: f"replace({x}, '+', '')")
    same = lambda c, f=lambda x: x: f"{f(c + '_a')} = {f(c + '_b')}"
    rule = lambda when, w: f"cast(case when {when} then {w} else 0 end as decimal(6,4))"
    first = jw(tidy("canonical_first_name_a"), tidy("canonical_first_name_b"))
    name = jw(full("a"), full("b"))
    return f"""select *, greatest(email_match, phone_match, canonical_exact_match) + name_similarity + soundex_match + address_similarity + email_domain_name_match + phone_partial_city_match score from (select source_a, key_a, source_b, key_b,
  {rule(same("email"), 1.0)} email_match,
  {rule(f"length({ten('phone_a')}) >= 10 and length({ten('phone_b')}) >= 10 and right({ten('phone_a')}, 10) = right({ten('phone_b')}, 10)", 0.95)} phone_match,
  {rule(f"{same('canonical_first_name', tidy)} and {same('last_name', tidy)}", 0.80)} canonical_exact_match,
  case when {name} >= 0.85 then cast(cast(round({name}, 6) as decimal(8,6)) * cast(0.30 as decimal(4,2)) as decimal(9,6)) else 0 end name_similarity,
  {rule(same("block_soundex"), 0.20)} soundex_match,
  {rule(f"{jw('street_a', 'street_b')} >= 0.80 and postal_code_a = postal_code_b" if bulk else "false", 0.25)} address_similarity,
  {rule(f"({domain('email_a')}) = ({domain('email_b')}) and {first} >= 0.90", 0.15)} email_domain_name_match,
  {rule(f"({suffix('phone_a', 7)}) = ({suffix('phone_b', 7)}) and {same('city', tidy)}" if bulk else "false", 0.10)} phone_partial_city_match from {pairs})"""


def _onehop(base: str, found: str) -> str:
    return f"""select r.source_system, r.source_key, coalesce(min(m.source_a || '|' || m.key_a), r.source_system || '|' || r.source_key) cluster_id
  from (select distinct source_system, source_key from {base}) r left join (select source_a, key_a, source_a s, key_a k from {found} union all select source_a, key_a, source_b, key_b from {found}) m on r.source_system = m.s and r.source_key = m.k group by 1, 2"""


_PRIORITY = "case source_system when 'CRM_A' then 1 when 'CRM_B' then 2 else 3 end"
_EMAIL, _NAME = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$", r"^[A-Za-z ''\-]+$"


def dq(mode: str) -> dict[str, str]:
    yes = lambda c: f"coalesce({c}, false)"
    good, first, last = yes(f"regexp_matches(email, '{_EMAIL}')"), yes("length(trim(first_name)) > 1"), yes("length(trim(last_name)) > 1")
    bad = "split_part(lower(email), '@', 2) in ('mailinator.com','tempmail.com','guerrillamail.com','10minutemail.com')"
    pts = lambda when, n: f"(case when {when} then {n} else 0 end)"
    return {
        "dq_001": pts(f"not {good}", -20),
        "dq_002": pts(yes(bad), -5),
        "dq_003": pts(f"not {first}", -20),
        "dq_004": pts(f"{first} and not regexp_matches(first_name, '{_NAME}')", -5),
        "dq_005": pts(f"not {last}", -20),
        "dq_006": pts(f"{last} and not regexp_matches(last_name, '{_NAME}')", -5),
        "dq_007": pts(f"phone is not null and {'phone <> %s and ' % repr('') if mode == 'nrt' else ''} not regexp_matches(phone, '^\\+?[0-9]{{10,15}}$')", -5),
        "dq_008": pts(yes(f"{digits('phone')} in ('0000000000','1111111111','1234567890')"), -20),
        "dq_c01": pts(f"not {good} and not {yes(f'length({digits("phone")}) >= 7')}", -20),
        "dq_c02": pts(f"not {first} and not {last}", -20),
        "dq_x03": pts(f"{first} and {yes('contains(lower(email), lower(trim(first_name)))')}", 5),
        "dq_ai01": pts("is_fake_name" if mode == "bulk" else "false", -20),
    }


def _clamp(rules: dict[str, str]) -> str:
    return f"cast(greatest(0, least(100, 100 + {' + '.join(rules.values())})) as integer)"


def _best(c: str, valid: str, key: str = "customer_id, file_date") -> str:
    return f"first_value({c}) over (partition by {key} order by case when {valid} then 0 else 1 end, p, file_date desc nulls last, source_key, coalesce({c}, '')) {c}"


ADDRESS_DQ = {
    "dq_011": "(case when coalesce(length(trim(street)), 0) < 5 then -5 else 0 end)",
    "dq_012": "(case when city is null then -20 else 0 end)",
    "dq_x04": "(case when length(trim(street)) >= 5 and postal_code is not null and city is not null then 10 else 0 end)",
}


def _hash(*columns: str) -> str:
    return "sha256(" + " || '|' || ".join(f"coalesce(cast({c} as varchar), '')" for c in columns) + ")"


HASH = _hash("first_name", "last_name", "email", "phone", "dq_score")
_ADDRESS_HASH = _hash("address_type", "street", "city", "postal_code", "country", "is_primary", "dq_score")


def _history(versions: str, columns: str, row_hash: str) -> str:
    order = "over (partition by customer_id order by file_date nulls first)"
    return f"""select {columns}, row_hash, cast(file_date as timestamp) valid_from, coalesce(lead(cast(file_date as timestamp)) {order}, timestamp '9999-12-31') valid_to, lead(file_date) {order} is null is_valid
  from (select *, lag(row_hash) {order} before_hash from (select *, {row_hash} row_hash from {versions})) where before_hash is null or before_hash <> row_hash"""


def tables(variant: str = "fuzzy") -> dict[str, str]:
    """The bulk tables of a variant and those of the event-driven engine, in the order in which they build on each other."""
    best_latest = lambda c, valid: f"first_value(nullif({c}, '')) over (partition by customer_id order by case when {valid} then 0 when {c} <> '' then 1 else 2 end, case when {valid} then {_PRIORITY} else 0 end, ts desc, source_system, source_key) {c}"
    name = lambda c: f"coalesce(length(trim({c})) > 1, false)"
    out = {"records": RECORDS, **RAW}
    out["customer_union"] = " union all ".join(
        (
            _customer("a", "src_customer_id", _A, _clean("last_name", "a"), "email", "phone"),
            _customer("b", "customer_key", f"split_part({_B}, ' ', 1)", last_words(_B), "email_address", "mobile"),
            _customer("c", "ticket_customer_id", f"split_part({_C}, ' ', 1)", last_words(_C), "callback_email", "callback_phone"),
        )
    )
    out["address_union"] = " union all ".join(
        (
            _address("a", "src_address_id", "src_customer_id", "street", "city", "postal_code", "country"),
            _address("b", "addr_id", "customer_key", "address_line", "city", "zip", "country_code"),
            _address("c", "addr_ref", "ticket_customer_id", "location", "town", "postcode", "country"),
        )
    )
    out["enriched"] = _AI if variant == "ai" else _FUZZY
    out["base"] = f"select distinct e.source_system, e.source_key, first_name, last_name, canonical_first_name, is_fake_name, email, phone, street, city, postal_code, {_BLOCKS} from enriched e left join address_union a on e.source_system = a.source_system and e.source_key = a.source_customer_key"
    out["pairs"] = _pairs("base")
    out["scores"] = _scores("pairs", "bulk")
    out["matches"] = "select distinct source_a, key_a, source_b, key_b from scores where score >= 0.70"
    out["clusters"] = _onehop("base", "matches")
    out["groups"] = "select cast(dense_rank() over (order by cluster_id) as bigint) customer_id, source_system, source_key, cluster_id from clusters"
    out["counts"] = "select customer_id, cast(count(distinct source_system) as integer) source_count from groups group by 1"
    out["survived"] = f"""select distinct customer_id, file_date, {_best("first_name", name("first_name"))}, {_best("last_name", name("last_name"))}, {_best("email", "email like '%@%'")}, {_best("phone", "length(phone) >= 7")},
  bool_or(is_fake_name) over (partition by customer_id) is_fake_name from (select g.customer_id, e.*, case e.source_system when 'CRM_A' then 1 when 'CRM_B' then 2 else 3 end p from groups g join enriched e on g.source_system = e.source_system and g.source_key = e.source_key)"""
    out["golden"] = f"select s.*, source_count, {_clamp(dq('bulk'))} dq_score from survived s join counts using (customer_id)"
    out["customers"] = "select customer_id, first_name, last_name, email, phone, dq_score, source_count, cast(file_date as timestamp) last_updated from golden qualify row_number() over (partition by customer_id order by file_date desc nulls last) = 1"
    out["customer_history"] = _history("golden", "customer_id, first_name, last_name, email, phone, dq_score", HASH)
    out["address_groups"] = "select distinct g.customer_id address_id, g.customer_id, a.source_system, a.source_key, cast(g.customer_id as varchar) cluster_id from address_union a join groups g on a.source_system = g.source_system and a.source_customer_key = g.source_key"
    country = "first_value(country) over (partition by customer_id, file_date order by case when country is not null then p else 99 end, file_date desc, p, source_key, coalesce(country, '')) country"
    out["address_survived"] = f"""select distinct customer_id address_id, customer_id, file_date, {_best("street", "length(trim(street)) >= 5")}, {_best("city", "city is not null")}, {_best("postal_code", "postal_code is not null")}, {country}
  from (select g.customer_id, u.*, {_PRIORITY.replace("source_system", "u.source_system")} p from address_groups g join address_union u on g.source_system = u.source_system and g.source_key = u.source_key)"""
    out["golden_addresses"] = f"select *, 'PRIMARY' address_type, true is_primary, {_clamp(ADDRESS_DQ)} dq_score from address_survived"
    out["current_addresses"] = "select * exclude (file_date) from golden_addresses qualify row_number() over (partition by customer_id order by file_date desc nulls last) = 1"
    out["address_history"] = _history("golden_addresses", "address_id, customer_id, address_type, street, city, postal_code, country, is_primary, dq_score", _ADDRESS_HASH)
    out["customer_xref"] = "select row_number() over (order by customer_id, source_system, source_key) xref_id, customer_id, source_system, source_key from groups"
    out["address_xref"] = "select row_number() over (order by address_id, source_system, source_key) xref_id, address_id, source_system, source_key from address_groups"
    out["nrt_records"] = f"select source_system, source_key, {initcap('first_name')} first_name, last_name, email, phone, cast(substr(source_key, 2) as bigint) * 37 % 1009 ts from records"
    out["nrt_base"] = f"select distinct source_system, source_key, first_name, last_name, {initcap('first_name')} canonical_first_name, email, phone, null street, null city, null postal_code, {_BLOCKS} from nrt_records"
    out["nrt_pairs"] = _pairs("nrt_base")
    out["nrt_scores"] = _scores("nrt_pairs", "nrt")
    out["nrt_matches"] = "select distinct source_a, key_a, source_b, key_b from nrt_scores where score >= 0.70"
    out["nrt_onehop"] = _onehop("nrt_base", "nrt_matches")
    out["nrt_edges"] = "select source_a || '|' || key_a x, source_b || '|' || key_b y from nrt_matches union select source_b || '|' || key_b, source_a || '|' || key_a from nrt_matches"
    out["nrt_reach"] = "select x, y from nrt_edges union select r.x, e.y from nrt_reach r join nrt_edges e on r.y = e.x"
    out["nrt_clusters"] = "select source_system, source_key, least(source_system || '|' || source_key, coalesce((select min(y) from nrt_reach r where r.x = source_system || '|' || source_key), source_system || '|' || source_key)) cluster_id from nrt_records"
    out["nrt_groups"] = "select cast(dense_rank() over (order by f) as bigint) customer_id, source_system, source_key, cluster_id from (select c.*, min((ts, c.source_system, c.source_key)) over (partition by cluster_id) f from nrt_clusters c join nrt_records r on c.source_system = r.source_system and c.source_key = r.source_key)"
    out["nrt_survived"] = f"""select distinct customer_id, {best_latest("first_name", name("first_name"))}, {best_latest("last_name", name("last_name"))}, {best_latest("email", "coalesce(email like '%@%', false)")}, {best_latest("phone", f"coalesce(length({digits('phone')}) >= 7, false)")},
  max(ts) over (partition by customer_id) ts from (select g.customer_id, r.* from nrt_groups g join nrt_records r on g.source_system = r.source_system and g.source_key = r.source_key)"""
    out["nrt_golden"] = f"select s.*, (select cast(count(distinct source_system) as integer) from nrt_groups g where g.customer_id = s.customer_id) source_count, {_clamp(dq('nrt'))} dq_score from nrt_survived s"
    out["crm_events"] = EVENTS
    out["ev_rows"] = " union all ".join(_event(*e) for e in (("a", "src_customer_id", "first_name", "last_name", None, "email", "phone"), ("b", "customer_key", None, None, "name", "email_address", "mobile"), ("c", "ticket_customer_id", None, None, "caller_name", "callback_email", "callback_phone")))
    out["ev_records"] = "select * from ev_rows qualify row_number() over (partition by source_system, source_key order by ts desc, arrival desc) = 1"
    for name in ("base", "pairs", "scores", "matches", "edges", "reach", "clusters", "survived", "golden"):
        out[f"ev_{name}"] = out[f"nrt_{name}"].replace("nrt_", "ev_")
    out["ev_numbers"] = "select source_system, source_key, row_number() over (order by source_system, source_key) n from ev_records"
    out["ev_groups"] = "select min(n) over (partition by cluster_id) customer_id, c.source_system, c.source_key, cluster_id from ev_clusters c join ev_numbers m on c.source_system = m.source_system and c.source_key = m.source_key"
    return {n: out[n] for n in sorted(out, key=lambda n: ("ev_survived", "ev_golden").index(n) + 1 if n in ("ev_survived", "ev_golden") else 0)}


def _event(system: str, key: str, first: str | None, last: str | None, name: str | None, email: str, phone: str) -> str:
    """One topic's good events in the common schema of the event-driven engine."""
    at = lambda f: f"payload->>'$.{f}'"
    full = f"({at(name)})" if name else ""
    capital = lambda x: initcap(f"trim(case when trim({x}) <> '' then {x} end)")
    first, last = capital(f"({at(first)})") if first else capital(f"split_part({full}, ' ', 1)"), capital(f"({at(last)})") if last else capital(last_words(full))
    mail, number = f"nullif(lower(trim({at(email)})), '')", f"nullif(regexp_replace({at(phone)}, '[^0-9+]', '', 'g'), '')"
    return f"""select 'CRM_{system.upper()}' source_system, {at(key)} source_key, {first} first_name, {last} last_name, {mail} email, {number} phone, ts, arrival
  from (select * from crm_events where topic = 'topic.crm.{system}' and json_valid(payload))"""


def sql(query: str, variant: str = "fuzzy") -> str:
    """A statement over the engine's tables, with those that it needs as common table expressions."""
    import re

    all_ = tables(variant)
    needed, todo = set(), [query]
    while todo:
        text = todo.pop()
        for name in all_:
            if name not in needed and re.search(rf"\b(from|join|,)\s+{name}\b", text):
                needed.add(name)
                todo.append(all_[name])
    ctes = ",\n".join(f"{n} as ({all_[n]})" for n in all_ if n in needed)
    return f"with recursive {ctes}\n{query}" if ctes else query
