"""CRM records derived from the driver's tables by SQL that runs alike on Spark and DuckDB."""

from __future__ import annotations

#: Customers of three systems: source_system, source_key, first_name, last_name, email, phone.
RECORDS = """select * from (with p as (select c_custkey as k,
  split_part('James,Mary,Robert,Linda,William,Susan,Michael,Karen,Richard,Nancy,Charles,Lisa,Thomas,Betty,Daniel,Helen,Margaret,Elizabeth,Theodore,Bill', ',', cast((c_custkey*7+c_nationkey)%20+1 as int)) as fn,
  split_part('Hart,Brook,Wins,Ash,Lang,Ster,Mill,Fair,Black,Green,Stan,Thorn,Whit,Clay,Red,Nor,Sut,Kirk,Hol,Brad', ',', cast((c_custkey*3+c_nationkey)%20+1 as int))
  || split_part('ley,man,ton,field,ford,well,worth,by,son,er,wood,burn,land,more,dale,ham,stone,den,cott,ridge,wick,gate,mont,shaw,cliffe,bury,combe,house,croft', ',', cast((c_custkey*13+c_nationkey*5)%29+1 as int)) as ln,
  lpad(cast((c_custkey*7919+1000003)%9000000000+1000000000 as string),10,'0') as ph from customer),
a as (select 'CRM_A' as source_system, 'A'||lpad(cast(k as string),6,'0') as source_key, fn as first_name, ln as last_name,
  lower(fn)||'.'||lower(ln)||cast(k as string)||'@example'||cast(k%9 as string)||'.com' as email, '+1'||ph as phone from p where k%10<6),
b as (select 'CRM_B','B'||lpad(cast(k as string),6,'0'), case when k%6=2 then substr(fn,1,2)||substr(fn,4) else fn end, ln,
  case when k%60=1 then 'invalid-email-format' when k%6=1 then lower(fn)||cast(k as string)||'@mailinator.com'
       else lower(fn)||'.'||lower(ln)||cast(k as string)||'@example'||cast(k%9 as string)||'.com' end,
  case when k%200=3 then '1111111111' else ph end from p where k%10 in (1,2,3,7)),
c as (select 'CRM_C','C'||lpad(cast(k as string),6,'0'), case when k%5=0 then upper(fn) else fn end, ln,
  case when k%8=2 then null else 'cb'||cast(k as string)||'@example'||cast(k%9 as string)||'.com' end,
  case when k%8=1 then null else '+1'||ph end from p where k%10 in (2,5,7,8,9))
select * from a union all select * from b union all select * from c) records"""

# Each system's raw feed: a first file with every record, a second with changes, a third that repeats some of these.
_K = "cast(substr(source_key,2) as int)"
_FILES = "(select 0 as v, '2024-01-01' as d union all select 1, '2024-02-01' union all select 2, '2024-03-01') files"
_VERSIONS = f"(v = 0 or (v = 1 and {_K} % 7 = 0) or (v = 2 and {_K} % 21 = 0))"
_PHONE = "substr(phone,1,2)||' ('||substr(phone,3,3)||') '||substr(phone,6,3)||'-'||substr(phone,9)"

RAW = {
    "raw_a": f"""select source_key as src_customer_id, case when {_K}%11=0 then upper(first_name) when {_K}%13=0 then lower(first_name) else first_name end as first_name,
  case when {_K}%17=0 then 'o'''||lower(last_name)||'-'||lower(first_name) else last_name end as last_name,
  '  '||upper(email)||' ' as email, case when v>0 and {_K}%2=0 then '+44 20 '||substr(phone,5) else {_PHONE} end as phone, d||'_crm_a_customers.csv' as _source_file
  from records, {_FILES} where source_system='CRM_A' and {_VERSIONS}""",
    "raw_b": f"""select source_key as customer_key, case when {_K}%31=1 then first_name else first_name||' '||last_name end as name,
  case when v>0 then 'new.'||email else email end as email_address, case when {_K}%29=2 then 'none' else phone end as mobile,
  case when {_K}%97=3 then 'undated' else d end||'_crm_b_customers.csv' as _source_file
  from records, {_FILES} where source_system='CRM_B' and {_VERSIONS}""",
    "raw_c": f"""select source_key as ticket_customer_id, lower(first_name)||' '||upper(last_name) as caller_name,
  case when email is null then 'N/A' else email end as callback_email, case when phone is null then 'NULL' else phone end as callback_phone, d||'_crm_c_customers.csv' as _source_file
  from records, {_FILES} where source_system='CRM_C' and {_VERSIONS}""",
    "addr_a": f"""select 'AA'||substr(source_key,2)||cast(n as string) as src_address_id, source_key as src_customer_id,
  case when {_K}%23=0 then '9 A' else ' '||cast({_K}%400+1 as string)||' '||lower(last_name)||' street' end as street,
  case when {_K}%19=0 then null else 'port '||lower(last_name) end as city, ' '||cast({_K}*37%90000+10000 as string)||case when n=1 then 'b' else '' end as postal_code, 'us' as country,
  d||'_crm_a_addresses.csv' as _source_file from records, {_FILES}, (select 0 as n union all select 1) numbers where source_system='CRM_A' and (n=0 or {_K}%8=0) and (v=0 or (v=1 and {_K}%12=0))""",
    "addr_b": f"""select 'AB'||substr(source_key,2) as addr_id, source_key as customer_key,
  cast({_K}%400+1 as string)||' '||last_name||case when v=1 then ' avenue' else ' str.' end as address_line, 'PORT '||upper(last_name) as city,
  cast({_K}*37%90000+10000 as string) as zip, case when {_K}%3=0 then 'GB ' else 'us' end as country_code,
  d||'_crm_b_addresses.csv' as _source_file from records, {_FILES} where source_system='CRM_B' and (v=0 or (v=1 and {_K}%9=0))""",
    "addr_c": f"""select 'AC'||substr(source_key,2) as addr_ref, source_key as ticket_customer_id, cast({_K}%400+1 as string)||' '||last_name||' Street' as location,
  'Port '||last_name as town, case when {_K}%5=0 then null else cast({_K}*37%90000+10000 as string) end as postcode, case when {_K}%14=0 then null else 'De' end as country,
  d||'_crm_c_addresses.csv' as _source_file from records, {_FILES} where source_system='CRM_C' and v=0""",
}

#: Events of three systems, some late and some malformed: topic, key, ts (seconds), payload (JSON).
EVENTS = """select case e.event_id % 4 when 0 then 'topic.crm.a' when 1 then 'topic.crm.b' when 2 then 'topic.crm.c' else 'topic.crm.d' end as topic,
  cast(e.user_id as string) as key, cast(e.event_id * 7919 % 100003 as bigint) as ts, e.event_id as arrival,
  case when e.event_id % 37 = 5 then '{"broken": ' else
    case e.event_id % 4 when 0 then '{"src_customer_id":"A'||cast(e.user_id as string)||'","first_name":"'||lower(e.event_type)||'","last_name":"user'||cast(e.user_id as string)||'","email":"U'||cast(e.user_id as string)||'@Example.com","phone":"+1 415 '||lpad(cast(e.event_id % 3 + e.user_id * 10 as string),7,'5')||'"}'
    when 1 then '{"customer_key":"B'||cast(e.user_id as string)||'","name":"'||upper(e.event_type)||' user'||cast(e.user_id as string)||'","email_address":"u'||cast(e.user_id as string)||'@example.com","mobile":null}'
    else '{"ticket_customer_id":"C'||cast(e.user_id as string)||'","caller_name":"'||e.event_type||'","callback_email":"","callback_phone":"415'||lpad(cast(e.user_id as string),7,'5')||'"}' end end as payload
  from events e"""
