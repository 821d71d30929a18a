"""The test-data derivations of ``careops.sources.testdata`` as DuckDB SQL.

Used only by the oracle: each query's reference SQL is prefixed with the CTEs
it needs (the oracle sees only the raw test tables).  Keep in step with the
DataFrame version.
"""

from __future__ import annotations

_CONTACT_ORDER = "case when {e}.event_id % 11 = 0 then null else {e}.event_id - {e}.event_id % 2 end"
_LOB = "case when {e}.user_id % 4 = 0 then 'Rider' else 'Customer' end"
_REASON = (
    "case {e}.event_id % 4 when 0 then 'late order' when 1 then 'missing item' "
    "when 2 then 'refund' else 'other' end"
)


def _f(text: str, e: str = "e") -> str:
    return text.format(e=e)


CTE: dict[str, str] = {
    "f_orders": """
select o.o_orderkey id, o.o_custkey user_id,
  o.o_orderdate + to_hours(o.o_orderkey % 24) delivered_at, o.o_orderdate created_at,
  cast(row_number() over (partition by o.o_custkey order by o.o_orderdate, o.o_orderkey) as int) order_rank_user,
  c.c_nationkey zone_id, n.n_name country_name, c.c_mktsegment city_name, m.restaurant_id,
  case when o.o_orderkey % 50 = 0 then '0.00' else cast(cast(o.o_totalprice as decimal(10,2)) as varchar) end subtotal,
  case o.o_orderstatus when 'F' then 'CANCELLED' when 'P' then 'CONFIRMED_BY_RESTAURANT' else 'DELIVERED' end status
from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey
left join (select l_orderkey, min(l_suppkey) restaurant_id from lineitem group by l_orderkey) m on m.l_orderkey = o.o_orderkey
""",
    "f_zones": """
select n_nationkey zone_id, case when n_regionkey in (0, 1) then 1 else 0 end core_zone from nation
""",
    "f_calls": f"""
select e.event_id call_guid, {_f(_CONTACT_ORDER)} order_id, {_f(_LOB)} origin_lob,
  e.ts start_timestamp, e.ts local_start_timestamp,
  e.ts + to_seconds(e.event_id % 60) local_first_queue_timestamp,
  e.ts + to_seconds(e.event_id % 60 + cast(floor(e.value) as bigint)) local_first_answer_timestamp,
  e.ts + to_seconds(e.event_id % 60 + cast(floor(e.value) as bigint) + e.event_id % 900 + e.event_id % 120) local_end_timestamp,
  e.event_id % 900 total_talk_time, e.event_id % 120 total_hold_time,
  e.event_id % 60 + cast(floor(e.value) as bigint) + e.event_id % 900 + e.event_id % 120 total_call_duration,
  e.event_id % 45 wrap_up_duration,
  e.event_id % 900 + e.event_id % 120 + e.event_id % 45 total_handle_time,
  'agent_' || cast(e.event_id % 37 as varchar) primary_agent_id,
  c.c_mktsegment city_name, '07' || lpad(cast(c.c_custkey as varchar), 9, '0') phone_cleaned,
  {_f(_REASON)} contact_reason, n.n_name origin_country_name,
  e.event_id % 3 = 0 csat_good, e.event_id % 3 = 1 csat_bad,
  e.event_id % 13 <> 0 was_answered, e.event_id % 17 = 0 was_abandoned_under_5_secs,
  e.value <= 15 was_ans_in_15s, e.value <= 30 was_ans_in_30s, e.value <= 45 was_ans_in_45s,
  e.value <= 60 was_ans_in_60s, e.value <= 90 was_ans_in_90s, e.value <= 120 was_ans_in_120s,
  e.value <= 300 was_ans_in_300s
from events e join customer c on c.c_custkey = e.user_id join nation n on n.n_nationkey = c.c_nationkey
where e.event_type = 'click'
""",
    "f_chats": f"""
select e.event_id id, {_f(_CONTACT_ORDER)} order_id, {_f(_LOB)} lob,
  e.ts chat_timestamp, e.ts local_chat_timestamp,
  e.ts + to_seconds(e.event_id % 90) local_first_response_timestamp,
  e.ts + to_seconds(e.event_id % 90 + e.event_id % 1200) local_end_timestamp,
  'agent_' || cast(e.event_id % 37 as varchar) agent_ids,
  c.c_mktsegment city_name, e.user_id visitor_id, {_f(_REASON)} contact_reason,
  e.event_id % 3 = 0 csat_good, e.event_id % 3 = 1 csat_bad,
  cast(1 + e.event_id % 25 as int) total_message_count,
  e.event_id % 17 = 0 was_abandoned_under_5_secs, e.event_id % 13 = 0 missed
from events e join customer c on c.c_custkey = e.user_id
""",
    "f_chatlog": """
select conv_id chat_id,
  timestamp '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) event_timestamp,
  case when role = 'system' then 'chat.system' else 'chat.msg' end event_type,
  role = 'user' is_visitor_event, role = 'assistant' is_agent_event, text message_body
from conversations
""",
    "f_emails": f"""
select {_f(_CONTACT_ORDER)} order_id, {_f(_LOB)} lob, e.ts created_at
from events e where e.event_type = 'signup'
""",
    "f_claims": """
select case when e.event_id % 23 = 0 then null else e.event_id - e.event_id % 4 end order_id,
  e.ts claim_time, e.event_id % 3 = 0 is_self_serve_claim,
  case e.event_id % 5 when 0 then 'late live order' when 1 then 'late order request credit'
    when 2 then 'missing item' else 'wrong order' end claim_reason,
  cast(case when e.value < 60 then 15.0 else e.value end as decimal(10,2)) claim_amount_gbp,
  cast(o.o_totalprice as decimal(12,2)) order_total_gbp
from events e left join orders o on o.o_orderkey = e.event_id - e.event_id % 4
where e.event_type = 'error'
""",
    "f_order_list": """
select o_orderkey orders from orders
union all
select o_orderkey orders from orders where o_orderpriority = '1-URGENT'
""",
    "f_items": """
select l.l_orderkey order_id, p.p_name mi_menu_category_name, p.p_brand mi_name, p.p_type mi_description,
  (((p.p_name like '%ring' or p.p_name like '%bolt') and p.p_partkey % 3 <> 0) or p.p_name = 'blue anvil') mi_alcohol,
  cast(l.l_quantity as decimal(6,0)) oi_quantity, cast(p.p_retailprice as decimal(10,2)) oi_unit_price
from lineitem l join part p on p.p_partkey = l.l_partkey
""",
    "f_adjustments": """
select l_orderkey order_id, cast(l_extendedprice as decimal(12,2)) adjustment_cost
from lineitem where l_returnflag = 'R'
""",
    "f_restaurants": """
select s_suppkey restaurant_id, s_name restaurant_name, n_name restaurant_company
from supplier join nation on n_nationkey = s_nationkey
""",
    "f_ledger": """
select l_suppkey restaurant_id, l_shipdate created_at,
  case when l_linenumber = 3 and l_returnflag = 'A' then null
       else cast(l_extendedprice as decimal(12,2)) end restaurant_order_net,
  case when l_suppkey % 10 = 0 then 'Free Trial'
       when l_linenumber = 7 then 'Free Trial' when l_linenumber = 6 then 'Redelivery'
       when l_linenumber = 5 and l_returnflag = 'N' then '0'
       else cast(10 + l_partkey % 25 as varchar) || '.50% + 0.' || lpad(cast(l_partkey % 100 as varchar), 2, '0') end commission_rate
from lineitem
""",
}


def with_ctes(body: str, *names: str) -> str:
    """``WITH <named CTEs> <body>``; pass the CTE names the body reads."""
    parts = ",\n".join(f"{n} as ({CTE[n].strip()})" for n in names)
    return f"with {parts}\n{body.strip()}"
