"""The registered queries again, as SQL over the same tables."""

VIEWS = {
    "transactions": """
select concat('T', lpad(cast(event_id as varchar), 12, '0')) as txn_id, ts as "timestamp",
       concat('ACC', lpad(cast(user_id as varchar), 10, '0')) as sender_account,
       concat('ACC', lpad(regexp_extract(props, '[0-9]+', 0), 10, '0')) as receiver_account,
       cast(cast(round(value * 100) as bigint) * 100 as double) as amount,
       case event_type when 'purchase' then 'NEFT' when 'view' then 'UPI' when 'signup' then 'IMPS'
            when 'error' then 'RTGS' else 'INTERNAL' end as txn_type,
       ['MOBILE','NETBANKING','BRANCH','ATM','API'][event_id % 5 + 1] as channel,
       'SUCCESS' as status, '' as description, value >= 250 as is_fraud,
       case when value >= 250 then ['CIRCULAR_ROUND_TRIP','LAYERING','STRUCTURING','DORMANT_ACTIVATION',
            'PROFILE_MISMATCH'][event_id % 5 + 1] end as fraud_type
from events""",
    "transfers": """
select txn_id, "timestamp" as ts, sender_account as src, receiver_account as dst, amount, txn_type, is_fraud, fraud_type
from transactions""",
    "accounts": """
select concat('ACC', lpad(cast(c_custkey as varchar), 10, '0')) as account_id,
       case c_mktsegment when 'AUTOMOBILE' then 'SAVINGS' when 'BUILDING' then 'CURRENT'
            when 'FURNITURE' then 'SALARY' when 'HOUSEHOLD' then 'DORMANT' else 'SHELL' end as account_type,
       c_name as customer_name,
       ['INDIVIDUAL','BUSINESS','STUDENT','RETIRED'][c_nationkey % 4 + 1] as customer_category,
       concat('BR', lpad(cast(c_nationkey as varchar), 4, '0')) as branch_code,
       case c_custkey % 10 when 8 then 'PENDING' when 9 then 'EXPIRED' else 'VERIFIED' end as kyc_status,
       cast(coalesce(date_diff('day', cast(first_order as date), date '2024-01-31'), 0) as integer) as account_age_days,
       cast(0 as double) as risk_score, c_acctbal < -500 as is_flagged
from customer left join (select o_custkey, min(o_orderdate) as first_order from orders group by o_custkey) f
     on f.o_custkey = c_custkey""",
    "moves": """
select account_id, dir, counterparty, txn_id, ts, amount, txn_type, is_fraud from (
  select src as account_id, 'sent' as dir, dst as counterparty, txn_id, ts, amount, txn_type, is_fraud from transfers
  union all
  select dst, 'received', src, txn_id, ts, amount, txn_type, is_fraud from transfers)""",
}
AS_OF = "timestamp '2024-01-31 00:00:00'"

ORACLE: dict[str, str] = {}


def _needed(text: str, views: dict[str, str]) -> list[str]:
    """Views mentioned in the text, directly or through others, in definition order."""
    wanted: set[str] = set()
    queue = [text]
    while queue:
        part = queue.pop()
        for name in views:
            if name not in wanted and f" {name}" in part.replace("\n", " ").replace("(", " "):
                wanted.add(name)
                queue.append(views[name])
    return [n for n in views if n in wanted]


def composed(body: str, recursive: bool = False, **extra: str) -> str:
    """``body`` with the common views it uses, then its own views, put in front."""
    views = {**VIEWS, **extra}
    names = _needed(body, views)
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(f"{n} as ({views[n]})" for n in names) + "\n" + body


def add(name: str, body: str, recursive: bool = False, **extra: str) -> None:
    """Register ``body`` with its views."""
    ORACLE[name] = composed(body, recursive, **extra).replace("$AS_OF", AS_OF)


# --- sources and quality --------------------------------------------------------------------------

add("transfers_build", """
select t.txn_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, src, dst, amount, txn_type, is_fraud
from transfers t where src in (select account_id from accounts) and dst in (select account_id from accounts)""")

add("transaction_nodes", """
select txn_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') as ts, amount, txn_type, channel, status, description,
       is_fraud, coalesce(fraud_type, '') as fraud_type
from transactions""")

add("sent_received_edges", """
select 'SENT' as relation, src as account_id, txn_id, amount, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts
from transfers where src in (select account_id from accounts)
union all
select 'RECEIVED_BY', dst, txn_id, amount, strftime(ts, '%Y-%m-%d %H:%M:%S')
from transfers where dst in (select account_id from accounts)""")

add("build_counters", """
select metric, cast(value as bigint) as value from (
  select count(*) as transactions,
         count(*) filter (s) as sent_rels, count(*) filter (r) as received_rels,
         count(*) filter (s and r) as transfer_rels, count(*) filter (not (s and r)) as orphan_transactions
  from (select src in (select account_id from accounts) as s, dst in (select account_id from accounts) as r from transfers) z)
unpivot (value for metric in (transactions, sent_rels, received_rels, transfer_rels, orphan_transactions))""")

add("accounts_upsert", """
select coalesce(a.account_id, b.account_id) as account_id,
       coalesce(b.account_type, a.account_type) as account_type,
       coalesce(b.customer_name, a.customer_name) as customer_name,
       case when b.account_id is not null then b.is_flagged else a.is_flagged end as is_flagged
from accounts a full join (
  select concat('ACC', lpad(cast(o_custkey + 1000 as varchar), 10, '0')) as account_id,
         'CURRENT' as account_type, arg_max(o_orderstatus, o_orderkey) as customer_name, false as is_flagged
  from orders group by o_custkey) b on a.account_id = b.account_id""")
ORACLE["accounts_upsert_buckets"] = ORACLE["accounts_upsert"]

add("risk_writeback", """
select a.account_id, coalesce(u.risk, a.risk_score) as risk_score,
       case when u.account_id is not null then u.flag else a.is_flagged end as is_flagged
from accounts a left join (
  select dst as account_id, least(count(*), 100) / 100.0::double as risk, max(amount) >= 500000 as flag
  from transfers group by dst) u on a.account_id = u.account_id""")

add("quality_violations", """
select txn_id as record_id, 'amount_range' as rule from transactions where not (amount between 100 and 50000000)
union all select txn_id, 'rtgs_minimum' from transactions where txn_type = 'RTGS' and amount < 200000
union all select txn_id, 'upi_maximum' from transactions where txn_type = 'UPI' and amount > 100000
union all select txn_id, 'account_type_band' from transactions join accounts on account_id = sender_account
  where not case account_type when 'SALARY' then amount between 20000 and 80000
       when 'CURRENT' then amount between 100 and 50000000 when 'SHELL' then amount between 100 and 50000000
       when 'DORMANT' then amount between 1000 and 500000 else amount between 100 and 5000000 end
union all select txn_id, 'sender_format' from transactions where not (starts_with(sender_account, 'ACC') and length(sender_account) = 13)
union all select txn_id, 'receiver_format' from transactions where not (starts_with(receiver_account, 'ACC') and length(receiver_account) = 13)
union all select account_id, 'account_id_format' from accounts where not (starts_with(account_id, 'ACC') and length(account_id) = 13)
union all select account_id, 'account_age_range' from accounts where account_age_days < 0""")

add("orphan_transfers", """
select txn_id, 'sender' as side from transactions where sender_account not in (select account_id from accounts)
union all select txn_id, 'receiver' from transactions
  where channel = 'ATM' or receiver_account not in (select account_id from accounts)""")

add("csv_round_trip", """
select txn_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') as ts, sender_account, receiver_account, amount, txn_type, channel, status, is_fraud
from transactions""")

add("accounts_appended", """
select account_id, account_type, customer_name, customer_category, branch_code, kyc_status,
       cast(account_age_days as bigint) as account_age_days, risk_score, is_flagged from accounts""")

add("transfers_by_day", """
select txn_id, src, dst, amount, txn_type, is_fraud, strftime(ts, '%Y-%m-%d') as day from transfers
where cast(ts as date) > date '2024-01-24' and cast(ts as date) <= date '2024-01-31'""")

ORACLE["duplicate_keys"] = "select cast(l_orderkey as varchar) as key, count(*) as copies from lineitem group by 1 having count(*) > 1"

add("dataset_profile", """
select * from (
select 'totals' as section, 'total_transactions' as item, cast(count(*) as varchar) as value from transactions
union all select 'totals', 'fraud_transactions', cast(count(*) filter (is_fraud) as varchar) from transactions
union all select 'totals', 'fraud_percent', printf('%.1f', count(*) filter (is_fraud) * 100.0::double / count(*)) from transactions
union all select 'totals', 'first_date', strftime(min("timestamp"), '%Y-%m-%d') from transactions
union all select 'totals', 'last_date', strftime(max("timestamp"), '%Y-%m-%d') from transactions
union all select 'totals', 'total_accounts', cast(count(*) as varchar) from accounts
union all select 'fraud_type', fraud_type, cast(count(*) as varchar) from transactions where is_fraud group by fraud_type
union all select 'account_type', account_type, cast(count(*) as varchar) from accounts group by account_type)""")

add("txn_defaults", """
select case when channel = 'ATM' then 'FAILED' else 'SUCCESS' end as status, txn_type = 'UPI' and is_fraud as is_fraud,
       case when amount >= 100000 then 13 else 64 end as id_length, count(*) as transactions, count(*) as ids
from transactions group by all""")

ORACLE["numeric_cleaning"] = """
select l_orderkey, sum(case when l_returnflag = 'N' then 0 else l_quantity end) as quantity,
       sum(case when l_tax = 0 or l_discount = 0 then 0 else l_quantity end) as ratio
from lineitem group by l_orderkey"""

add("alert_quality", """
select account_id as record_id, 'alert_risk_range' as rule from accounts where account_age_days > 10000
union all select account_id, 'risk_tier_domain' from accounts where is_flagged
union all select account_id, 'status_domain' from accounts where kyc_status = 'EXPIRED'""")

# --- patterns -------------------------------------------------------------------------------------

TRAILS = {
    "win": "select src, dst, txn_id, amount, ts from transfers where ts > $AS_OF - interval 72 hour and ts <= $AS_OF",
    "walk": """
select src as anchor, dst as cur, [txn_id] as txns, [src, dst] as nodes, [amount] as amounts, amount as total, 1 as n from win
union all
select anchor, w.dst, list_append(txns, w.txn_id), list_append(nodes, w.dst), list_append(amounts, w.amount), total + w.amount, n + 1
from walk join win w on walk.cur = w.src where n < 5 and not list_contains(txns, w.txn_id)""",
    "cyc": "select * from walk where n >= 2 and cur = anchor",
}
add("circular_round_trips", """
select anchor as anchor_account, array_to_string(nodes, ',') as account_ids, array_to_string(txns, ',') as txn_ids,
       array_to_string(list_transform(amounts, lambda x: cast(cast(x as bigint) as varchar)), ',') as amounts,
       total as total_amount, cast(n as bigint) as cycle_length
from cyc""", True, **TRAILS)

LAYER = {
    "pairs": """
select r1.src as source, r1.dst as mid, r2.dst as dest, r1.txn_id as t1, r2.txn_id as t2, r1.amount as a1, r2.amount as a2
from transfers r1 join transfers r2 on r1.dst = r2.src
where r1.amount > 300000 and r1.ts > $AS_OF - interval 72 hour and r1.ts <= $AS_OF and r2.ts <= $AS_OF
  and r2.ts > r1.ts and r2.ts < r1.ts + interval 72 hour
  and r1.src <> r2.dst and r1.src <> r1.dst and r1.dst <> r2.dst""",
    "lay": """
select source as source_account, dest as destination_account, count(distinct mid) as intermediary_count,
       sum(a1) as total_fan_out, sum(a2) as total_converge,
       array_to_string(list_sort(list_distinct(list(mid))), ',') as intermediate_accounts,
       array_to_string(list_sort(list_distinct(list(t1))), ',') as fan_out_txns,
       array_to_string(list_sort(list_distinct(list(t2))), ',') as converge_txns
from pairs group by source, dest having count(distinct mid) >= 2""",
}
add("layering", "select source_account, destination_account, intermediary_count, total_fan_out, total_converge from lay", **LAYER)
add("layering_evidence", """
select distinct source as source_account, dest as destination_account, mid as intermediate_account, leg, txn_id, amount
from (select source, dest, mid, 'fan_out' as leg, t1 as txn_id, a1 as amount from pairs
      union all select source, dest, mid, 'converge', t2, a2 from pairs) z
where (source, dest) in (select source_account, destination_account from lay)""", **LAYER)
add("layering_top", """
select source_account, destination_account, intermediary_count, total_fan_out, total_converge from lay
order by total_fan_out desc, source_account, destination_account limit 1000""", **LAYER)

STRUCT = {
    "small": "select * from transfers where amount > 0 and amount <= 49999 and ts > $AS_OF - interval 240 hour and ts <= $AS_OF",
    "stru": """
select dst as destination_account, count(distinct src) as sender_count, count(*) as transaction_count, sum(amount) as total_amount
from small group by dst having count(*) >= 5""",
}
add("structuring", "select * from stru", **STRUCT)
add("structuring_evidence", """
select dst as destination_account, src as sender_account, txn_id, amount from small
where dst in (select destination_account from stru)""", **STRUCT)

add("structuring_sliding", """
select dst as destination_account, max(n) as max_transaction_count, max(total) as max_total_amount,
       strftime(min(ts) filter (n >= 5), '%Y-%m-%d %H:%M:%S') as first_reached
from (select dst, ts, count(*) over w as n, sum(amount) over w as total from transfers
      where amount > 0 and amount <= 49999 and ts <= $AS_OF
      window w as (partition by dst order by ts range between interval '23:59:59.999999' preceding and current row)) z
where n >= 5 group by dst""")

DORM = {
    "dorm": """
select a.account_id, account_type, account_age_days, activation_amount, forwarded_amount,
       forwarded_amount / activation_amount as forward_ratio, incoming_count, outgoing_count
from accounts a
join (select dst, sum(amount) as activation_amount, count(*) as incoming_count from transfers
      where ts > $AS_OF - interval 30 day and ts <= $AS_OF group by dst) i on i.dst = a.account_id
join (select src, sum(amount) as forwarded_amount, count(*) as outgoing_count from transfers
      where ts > $AS_OF - interval 30 day and ts <= $AS_OF group by src) o on o.src = a.account_id
where (account_type = 'DORMANT' or account_age_days > 60) and forwarded_amount > activation_amount * $RATIO""",
}
add("dormant", """
select account_id, account_type, cast(account_age_days as bigint) as account_age_days, activation_amount, forwarded_amount,
       round(forward_ratio, 6) as forward_ratio, incoming_count, outgoing_count
from dorm""", dorm=DORM["dorm"].replace("$RATIO", "0.7"))

add("dormant_evidence", """
select d.account_id, case m.dir when 'sent' then 'outgoing' else 'incoming' end as direction, counterparty, txn_id, amount
from dorm d join moves m on m.account_id = d.account_id where m.ts > $AS_OF - interval 30 day and m.ts <= $AS_OF""",
    dorm=DORM["dorm"].replace("$RATIO", "0.7"))

WOKEN = {"woken": """
select c.dst as account_id, c.txn_id, strftime(c.ts, '%Y-%m-%d %H:%M:%S') as activated_at,
       strftime(h.quiet_since, '%Y-%m-%d %H:%M:%S') as quiet_since,
       round(h.mean_before, 4) as mean_before, c.amount as activation_amount, f.forwarded_amount
from transfers c
join lateral (select max(m.ts) as quiet_since, avg(m.amount) as mean_before from moves m where m.account_id = c.dst and m.ts < c.ts) h on true
join lateral (select sum(o.amount) as forwarded_amount from transfers o
      where o.src = c.dst and o.ts > c.ts and o.ts <= c.ts + interval 10 day and o.ts <= $AS_OF) f on true
where c.ts <= $AS_OF and c.ts >= h.quiet_since + interval 1 day and c.amount > 1.5 * h.mean_before
  and f.forwarded_amount > 0.5 * c.amount"""}
add("dormant_strict", "select * from woken", **WOKEN)

PROF = {
    "prof": """
select account_id, customer_category as category, customer_name, count(*) as credit_count, sum(amount) as total_suspicious_amount
from transfers join accounts on dst = account_id
where customer_category in ('STUDENT', 'RETIRED') and amount >= 500000 and ts <= $AS_OF group by all""",
}
add("profile_mismatch", "select * from prof", **PROF)
add("profile_evidence", """
select account_id, src as sender, amount, txn_id from transfers join accounts on dst = account_id
where customer_category in ('STUDENT', 'RETIRED') and amount >= 500000 and ts <= $AS_OF""")

FOUND = {
    **TRAILS, **LAYER, **STRUCT, **PROF, "dorm": DORM["dorm"].replace("$RATIO", "0.7"),
    "involved": """
select distinct 'CIRCULAR_ROUND_TRIP' as pattern, array_to_string(txns, '>') as detection_id, unnest(nodes) as account_id from cyc
union select 'LAYERING', source || '>' || dest, a from (
  select source, dest, unnest([source, mid, dest]) as a from pairs
  where (source, dest) in (select source_account, destination_account from lay)) z
union select 'STRUCTURING', dst, unnest([src, dst]) from small where dst in (select destination_account from stru)
union select 'DORMANT_ACTIVATION', account_id, account_id from dorm
union select 'PROFILE_MISMATCH', account_id, account_id from prof""",
}
add("pattern_counts", """
select * from (
select 'CIRCULAR_ROUND_TRIP' as pattern, count(*) as detections from cyc
union all select 'LAYERING', count(*) from lay union all select 'STRUCTURING', count(*) from stru
union all select 'DORMANT_ACTIVATION', count(*) from dorm union all select 'PROFILE_MISMATCH', count(*) from prof
union all select 'TOTAL', (select count(*) from cyc) + (select count(*) from lay) + (select count(*) from stru)
                         + (select count(*) from dorm) + (select count(*) from prof)) y""", True, **FOUND)
add("involvement", "select pattern, account_id, count(*) as detections from involved group by all", True, **FOUND)

add("detector_eval", """
select pattern, detected, fraud_detected, own_detected, own_labelled, labelled,
       round(coalesce(fraud_detected / nullif(detected, 0), 0), 6) as precision,
       round(coalesce(fraud_detected / nullif(labelled, 0), 0), 6) as recall,
       round(coalesce(own_detected / nullif(own_labelled, 0), 0), 6) as own_recall
from (select p.pattern, count(b.txn_id) as detected, count(*) filter (t.is_fraud) as fraud_detected,
             count(*) filter (t.is_fraud and t.fraud_type = p.pattern) as own_detected,
             (select count(*) from transfers where fraud_type = p.pattern) as own_labelled,
             (select count(*) from transfers where is_fraud) as labelled
      from (select unnest(['CIRCULAR_ROUND_TRIP','LAYERING','STRUCTURING','DORMANT_ACTIVATION','PROFILE_MISMATCH']) as pattern) p
      left join behind b on b.pattern = p.pattern left join transfers t on t.txn_id = b.txn_id group by p.pattern) y""", True,
    **FOUND, behind="""
select distinct 'CIRCULAR_ROUND_TRIP' as pattern, unnest(txns) as txn_id from cyc
union select 'LAYERING', unnest([t1, t2]) from pairs where (source, dest) in (select source_account, destination_account from lay)
union select 'STRUCTURING', txn_id from small where dst in (select destination_account from stru)
union select 'DORMANT_ACTIVATION', m.txn_id from moves m join dorm d on m.account_id = d.account_id
  where m.ts > $AS_OF - interval 30 day and m.ts <= $AS_OF
union select 'PROFILE_MISMATCH', txn_id from transfers join prof on dst = account_id where amount >= 500000 and ts <= $AS_OF""")

# --- traversal and export -------------------------------------------------------------------------

NEAR = {
    "links": "select src as a, dst as b from transfers where src <> dst union select dst, src from transfers where src <> dst",
    "flagged": "select account_id from accounts where is_flagged",
    "ball": """
select center, node, min(hop) as hop from (
  select account_id as center, account_id as node, 0 as hop from flagged
  union all select f.account_id, l.b, 1 from flagged f join links l on l.a = f.account_id
  union all select f.account_id, m.b, 2 from flagged f join links l on l.a = f.account_id join links m on m.a = l.b) z
where center in (select a from links) group by all""",
}
add("subgraph_nodes", """
select center, account_id, cast(hop as bigint) as hop, account_type, customer_name, customer_category, risk_score, is_flagged, kyc_status
from ball join accounts on node = account_id""", **NEAR)
add("subgraph_edges", """
select b1.center, txn_id, src, dst, amount, txn_type, is_fraud from transfers
join ball b1 on b1.node = src join ball b2 on b2.node = dst and b2.center = b1.center where b1.hop <= 1 and b2.hop <= 1""", **NEAR)
add("subgraph_edges_reached", """
select b1.center, txn_id, src, dst, amount, txn_type, is_fraud from transfers
join ball b1 on b1.node = src join ball b2 on b2.node = dst and b2.center = b1.center
where b1.hop <= 1 and b2.hop <= 1 and (b1.hop < 1 or b2.hop < 1)""", **NEAR)

PATHS = {
    "flagged": NEAR["flagged"],
    "wanted": "select distinct dst as source, src as dest from transfers where src in (select account_id from flagged) and src <> dst",
    "hops": """
select distinct source, source as node, 0 as hop from wanted
union select source, dst, hop + 1 from hops join transfers on src = node where hop < 10""",
    "near": "select source, node, min(hop) as hop from hops group by all",
    "entry": """
select n.source, n.node, n.hop, min(t.src) as previous from near n join transfers t on t.dst = n.node
join near p on p.source = n.source and p.node = t.src and p.hop = n.hop - 1 group by all""",
    "line": """
select w.source, w.dest, n.hop as path_length, n.hop as hop, w.dest as node, [w.dest] as nodes,
       cast([] as varchar[]) as txn_ids, cast(0 as double) as total_amount
from wanted w join near n on n.source = w.source and n.node = w.dest
union all
select l.source, l.dest, path_length, l.hop - 1, e.previous, list_prepend(e.previous, nodes),
       list_prepend(s.txn_id, txn_ids), total_amount + s.amount
from line l join entry e on e.source = l.source and e.node = l.node
join single s on s.src = e.previous and s.dst = l.node where l.hop > 0""",
    "single": "select src, dst, min(txn_id) as txn_id, arg_min(amount, txn_id) as amount, arg_min(is_fraud, txn_id) as is_fraud from transfers group by src, dst",
}
PATHS = {k: PATHS[k] for k in ("flagged", "wanted", "hops", "near", "entry", "single", "line")}
add("fund_paths", """
select source, dest, cast(path_length as bigint) as path_length, total_amount, array_to_string(nodes, ',') as nodes,
       array_to_string(txn_ids, ',') as txn_ids, array_to_string(nodes[2:path_length], ',') as intermediate_accounts
from line where hop = 0""", True, **PATHS)
add("fund_path_export", """
select path_source, path_dest, id, src as source, dst as target, amount,
       case when is_fraud then '#FF4757' else 'rgba(255, 255, 255, 0.3)' end as color,
       round(1 + amount / nullif(max(amount) over (partition by path_source, path_dest), 0) * 7, 1) as width
from (select l.source as path_source, l.dest as path_dest, unnest(txn_ids) as id from line l where hop = 0) z
join single on single.txn_id = z.id""", True, **PATHS)

MEMBERS = {**FOUND, "members": """
select distinct pattern || ':' || detection_id as detection_id, account_id from involved"""}
add("pattern_subgraph_nodes", """
select m.detection_id, a.account_id, account_type, customer_name, risk_score, is_flagged
from members m join accounts a on a.account_id = m.account_id""", True, **MEMBERS)
add("pattern_subgraph_edges", """
select m1.detection_id, txn_id, src, dst, amount, txn_type, is_fraud from transfers
join members m1 on m1.account_id = src join members m2 on m2.account_id = dst and m2.detection_id = m1.detection_id""", True, **MEMBERS)

add("edge_list", "select distinct src as source, dst as target from transfers")

DRAWN = {
    "raw_nodes": """
select a.account_id as id, account_type, customer_name, customer_category, is_flagged, kyc_status,
       coalesce(total_sent, 0) as total_sent, coalesce(total_received, 0) as total_received,
       least(coalesce(marked, 0), 4) / 4 as risk
from accounts a left join (
  select account_id, sum(amount) filter (dir = 'sent') as total_sent, sum(amount) filter (dir = 'received') as total_received,
         count(*) filter (is_fraud) as marked from moves group by account_id) v on v.account_id = a.account_id""",
    "raw": """
select txn_id, src, case when txn_type = 'RTGS' then 'X' || substr(dst, 2) else dst end as dst, amount, txn_type, is_fraud from transfers""",
    "valid": """
select txn_id as id, src as source, dst as target, amount, txn_type, is_fraud, '' as fraud_type,
       case when is_fraud then '#FF4757' else 'rgba(255, 255, 255, 0.3)' end as color,
       round(1 + amount / (select max(amount) from transfers) * 7, 1) as width
from raw where src in (select id from raw_nodes) and dst in (select id from raw_nodes)""",
}
add("graph_export_nodes", """
select id, substr(id, 1, 10) as label, round(risk * 100, 1) as risk_score, tier as risk_tier,
       account_type, customer_name, customer_category, total_sent, total_received, is_flagged, kyc_status,
       case tier when 'CRITICAL' then '#FF4757' when 'HIGH' then '#FF6B35' when 'MEDIUM' then '#FFA502'
            when 'LOW' then '#2ED573' else '#636E72' end as color,
       cast(floor(20 + (total_sent + total_received) / (select max(total_sent + total_received) from raw_nodes) * 60) as bigint) as size
from (select *, case when risk * 100 >= 76 then 'CRITICAL' when risk * 100 >= 56 then 'HIGH'
      when risk * 100 >= 31 then 'MEDIUM' when risk * 100 > 0 then 'LOW' else 'NONE' end as tier from raw_nodes) z""", **DRAWN)
add("graph_export_edges", "select * from valid", **DRAWN)
add("graph_export_summary", """
select (select count(*) from raw_nodes) as nodes, (select count(*) from valid) as edges,
       (select count(*) from transfers) - (select count(*) from valid) as dropped_edges""", **DRAWN)

# --- features -------------------------------------------------------------------------------------

FEAT = {
    "seen": "select distinct account_id, dir, counterparty, ts, amount from moves where ts <= $AS_OF",
    "feat": """
select a.account_id, account_type, is_flagged, cast(account_age_days as bigint) as account_age_days,
  coalesce(sum(amount) filter (dir = 'sent' and ts > $AS_OF - interval 30 day), 0) as total_sent_30d,
  coalesce(sum(amount) filter (dir = 'received' and ts > $AS_OF - interval 30 day), 0) as total_received_30d,
  count(*) filter (ts > $AS_OF - interval 30 day) as txn_count_30d,
  count(distinct counterparty) filter (ts > $AS_OF - interval 30 day) as unique_counterparties_30d,
  coalesce(avg(amount), 0) as avg_txn_amount, coalesce(max(amount), 0) as max_single_txn,
  count(*) filter (dir = 'sent' and ts > $AS_OF - interval 7 day)
    / (count(*) filter (dir = 'sent' and ts > $AS_OF - interval 14 day and ts <= $AS_OF - interval 7 day) + 1) as velocity_7d,
  cast(account_type = 'DORMANT' as bigint) as is_dormant_activated,
  coalesce(sqrt(greatest(0, sum(amount * amount) / count(amount) - (sum(amount) / count(amount)) ** 2)), 0) as std_txn_amount,
  coalesce(count(*) filter (hour(ts) >= 23 or hour(ts) < 5) / nullif(count(ts), 0), 0) as night_txn_ratio,
  date_diff('day', cast(max(ts) as date), date '2024-01-31') as days_since_last_txn
from accounts a left join seen on seen.account_id = a.account_id group by a.account_id, account_type, is_flagged, a.account_age_days""",
    "deg": """
select account_id, coalesce(n_in, 0) as in_degree, coalesce(n_out, 0) as out_degree, coalesce(n_in, 0) + coalesce(n_out, 0) as degree
from accounts left join (select dst, count(distinct src) as n_in from transfers group by dst) i on i.dst = account_id
left join (select src, count(distinct dst) as n_out from transfers group by src) o on o.src = account_id""",
}
add("account_features", """
select account_id, account_type, is_flagged, account_age_days, total_sent_30d, total_received_30d, txn_count_30d,
  unique_counterparties_30d, round(avg_txn_amount, 4) as avg_txn_amount, max_single_txn, round(velocity_7d, 4) as velocity_7d,
  is_dormant_activated, round(std_txn_amount, 4) as std_txn_amount, round(night_txn_ratio, 4) as night_txn_ratio,
  days_since_last_txn, round(total_sent_30d / (total_received_30d + 1), 4) as sent_received_ratio
from feat""", **FEAT)
add("features_reused", "select account_id, total_sent_30d, txn_count_30d, max_single_txn from feat", **FEAT)
ORACLE["features_incremental"] = ORACLE["features_refreshed"] = ORACLE["account_features"]
add("counterparty_sketches", "select account_id, unique_counterparties_30d, true as merged_near, true as at_once_near from feat", **FEAT)
add("activated_features", """
select account_id, cast(account_id in (select account_id from woken) as bigint) as is_dormant_activated, txn_count_30d from feat""",
    **FEAT, **WOKEN)
add("graph_features", """
select account_id, in_degree, out_degree, degree,
  round(0.15::double / (select count(*) from deg) + 0.85::double * degree / (select sum(degree) from deg), 9) as degree_share_rank
from deg""", **FEAT)

RANK = {
    "pairs": """
select distinct src, dst from transfers where src in (select account_id from accounts) and dst in (select account_id from accounts)""",
    "outs": "select src, count(*) as d from pairs group by src",
    "n": "select count(*) as n from accounts",
    "r0": "select account_id, 1.0::double / (select n from n) as r from accounts",
}
for _k in range(1, 21):
    RANK[f"r{_k}"] = f"""
select a.account_id, 0.15::double / (select n from n) + 0.85::double * (coalesce(c.r, 0) + (
         select coalesce(sum(r), 0) from r{_k - 1} where account_id not in (select src from outs)) / (select n from n)) as r
from accounts a left join (
  select p.dst, sum(x.r / o.d) as r from pairs p join outs o on o.src = p.src join r{_k - 1} x on x.account_id = p.src group by p.dst) c
  on c.dst = a.account_id"""
add("pagerank", "select account_id, round(r, 9) as pagerank_score from r20", **RANK)

BETWEEN = {
    "arcs": "select distinct src as tail, dst as head from transfers where src <> dst",
    "walks": """
select account_id as start, account_id as node, 0 as hop from accounts where account_id in (select tail from arcs)
union select start, head, hop + 1 from walks join arcs on tail = node where hop < 20""",
    "dist": "select start, node, min(hop) as hop from walks group by all",
    "counted": """
select start, node, hop, 1.0::double as paths from dist where hop = 0
union all
select c.start, d.node, d.hop, sum(c.paths) from counted c join arcs on tail = c.node
join dist d on d.start = c.start and d.node = head and d.hop = c.hop + 1 group by all""",
    "through": """
select a.node as account_id, sum(a.paths * b.paths / c.paths) as share from counted a
join counted b on b.start = a.node and b.hop > 0 join counted c on c.start = a.start and c.node = b.node and c.hop = a.hop + b.hop
where a.hop > 0 group by all""",
    "betw": """
select a.account_id, coalesce(share, 0) / (select greatest((count(*) - 1) * (count(*) - 2), 1) from accounts) as betweenness_centrality
from accounts a left join through t on t.account_id = a.account_id""",
}
SAMPLED = {
    "starts": "select account_id from accounts order by md5(account_id), account_id limit 100", **BETWEEN,
    "through": BETWEEN["through"].replace("where a.hop > 0", "where a.hop > 0 and a.start in (select account_id from starts)"),
    "betw": BETWEEN["betw"].replace(
        "coalesce(share, 0) /", "coalesce(share, 0) * (select count(*) from accounts) / (select count(*) from starts) /"),
}
add("betweenness_sampled", "select account_id, round(betweenness_centrality, 9) as betweenness_centrality from betw", True, **SAMPLED)
add("betweenness", "select account_id, round(betweenness_centrality, 9) as betweenness_centrality from betw", True, **BETWEEN)

CLUSTER = {
    "links": NEAR["links"],
    "clus": """
select account_id, case when d >= 2 then coalesce(t, 0) / (d * (d - 1)) else 0 end as clustering_coefficient
from accounts left join (select a, count(*) as d from links group by a) g on g.a = account_id
left join (select x.a, count(*) as t from links x join links y on y.a = x.a join links z on z.a = x.b and z.b = y.b group by x.a) h
  on h.a = account_id""",
}
add("clustering", "select account_id, round(clustering_coefficient, 6) as clustering_coefficient from clus", **CLUSTER)

CYCLE_FEATURES = {**TRAILS, "onc": "select account_id, max(n) as longest from (select unnest(nodes) as account_id, n from cyc) group by account_id"}
add("cycle_features", """
select a.account_id, cast(longest is not null as bigint) as is_in_cycle, cast(coalesce(longest, 0) as bigint) as max_cycle_length
from accounts a left join onc on onc.account_id = a.account_id""", True, **CYCLE_FEATURES)

HOPS = {
    "links": NEAR["links"],
    "far": """
select account_id, 0 as hop from accounts where is_flagged
union select l.b, hop + 1 from far join links l on l.a = account_id where hop < 12""",
    "least_far": "select account_id, min(hop) as hop from far group by account_id",
}
add("hops_to_flagged", """
select a.account_id, cast(hop as bigint) as hop_count_to_flagged from accounts a left join least_far f on f.account_id = a.account_id""",
    True, **HOPS)

_CHECKED = (
    "account_age_days total_sent_30d total_received_30d txn_count_30d unique_counterparties_30d avg_txn_amount max_single_txn "
    "velocity_7d is_dormant_activated std_txn_amount night_txn_ratio days_since_last_txn sent_received_ratio in_degree out_degree "
    "is_in_cycle max_cycle_length hop_count_to_flagged betweenness_centrality clustering_coefficient pagerank_score"
).split()
_GAPS = {
    "days_since_last_txn": "account_age_days",
    "hop_count_to_flagged": "(select max(hop) + 1 from least_far l join accounts a on a.account_id = l.account_id)",
}
add("feature_matrix", "select account_id, " + ", ".join(
    f"round(case when stddev_pop({c}) over () <= 1e-14 * greatest(abs(avg({c}) over ()), 1) then 0 "
    f"else ({c} - avg({c}) over ()) / stddev_pop({c}) over () end, 6) as {c}" for c in _CHECKED) + " from wide", True,
    **{**FEAT, **CYCLE_FEATURES, **HOPS, **BETWEEN, **CLUSTER, **RANK}, wide="select f.account_id, " + ", ".join(f"cast(coalesce({c}, {_GAPS.get(c, 0)}) as double) as {c}" for c in _CHECKED) + """
from (select *, total_sent_30d / (total_received_30d + 1) as sent_received_ratio from feat) f
join (select account_id, in_degree, out_degree from deg) d on d.account_id = f.account_id
left join (select account_id, 1 as is_in_cycle, longest as max_cycle_length from onc) o on o.account_id = f.account_id
left join (select account_id, hop as hop_count_to_flagged from least_far) h on h.account_id = f.account_id
join betw on betw.account_id = f.account_id join clus on clus.account_id = f.account_id
join (select account_id, r as pagerank_score from r20) r on r.account_id = f.account_id""")

add("labels", """
select account_id, account_id in (select account_id from moves where is_fraud) as is_fraud from accounts""")

# --- node scores ----------------------------------------------------------------------------------

MODEL = {
    "medges": """
select src, dst from (select distinct src, dst from transfers where src in (select account_id from accounts)
  and dst in (select account_id from accounts)) z
union all select account_id, account_id from accounts""",
}
add("model_edges", "select src as source, dst as target, count(*) as copies from medges group by all", **MODEL)

_BEHAVIOUR = _CHECKED[:13]
FILLED = {"filled": "select account_id, " + ", ".join(f"cast(coalesce({c}, {_GAPS.get(c, 0)}) as double) as {c}" for c in _BEHAVIOUR)
          + " from (select *, total_sent_30d / (total_received_30d + 1) as sent_received_ratio from feat) z"}
_HOP = "select dst as account_id, " + ", ".join(f"avg({c}) as {c}" for c in _BEHAVIOUR) + " from medges join $FROM x on x.account_id = src group by dst"
add("neighbour_means", "select f.account_id, " + ", ".join(
    f"round(f.{c}, 3) as {c}, round(h1.{c}, 3) as {c}_h1, round(h2.{c}, 3) as {c}_h2, round(h3.{c}, 3) as {c}_h3" for c in _BEHAVIOUR)
    + " from filled f join h1 on h1.account_id = f.account_id join h2 on h2.account_id = f.account_id join h3 on h3.account_id = f.account_id",
    **FEAT, **FILLED, **MODEL, h1=_HOP.replace("$FROM", "filled"), h2=_HOP.replace("$FROM", "h1"), h3=_HOP.replace("$FROM", "h2"))

LABELS = {"lab": "select account_id, account_id in (select account_id from moves where is_fraud) as is_fraud from accounts"}
add("class_weights", """
select is_fraud, count(*) as accounts, round(case when is_fraud then (select count(*) filter (not is_fraud) / count(*) filter (is_fraud) from lab)
       else 1 end, 6) as weight from lab group by is_fraud""", **LABELS)
add("split", """
select is_fraud, v as is_validation, case when v then quota else n - quota end as accounts
from (select is_fraud, count(*) as n, cast(round_even(count(*) * 0.2::double, 0) as bigint) as quota from lab group by is_fraud) z,
     (select unnest([true, false]) as v) y where case when v then quota else n - quota end > 0""", **LABELS)


def _sage() -> dict[str, str]:
    """The fixed small network, layer by layer."""
    def cell(i, j, shift):
        return ((3 * i + 5 * j + shift) % 7 - 3) / 4

    views = {"l0": "select account_id, txn_count_30d / 100 as x0, velocity_7d / 10 as x1 from feat"}
    before, width = "l0", 2
    for n, size in enumerate((4, 3, 2), 1):
        mean = ", ".join(f"avg(x{j}) as m{j}" for j in range(width))
        views[f"a{n}"] = f"select dst as account_id, {mean} from medges join {before} x on x.account_id = src group by dst"
        def out(i):
            terms = [f"{cell(i, j, n)} * m{j} + {cell(i, j, n + 2)} * x{j}" for j in range(width)]
            return f"greatest({cell(0, i, n + 1)} + " + " + ".join(terms) + f", 0) as x{i}"
        views[f"l{n}"] = f"select x.account_id, {', '.join(out(i) for i in range(size))} from {before} x join a{n} m on m.account_id = x.account_id"
        before, width = f"l{n}", size
    logit = " + ".join(f"({cell(1, i, 4)} - {cell(0, i, 4)}) * x{i}" for i in range(width))
    views["net"] = f"select account_id, 1 / (1 + exp(-({logit} - 0.75))) as p, x0, x1 from l3"
    return views


add("sage_scores", """
select account_id, round(p, 9) as gnn_fraud_prob, round(cast(x0 as double), 9) as e0, round(cast(x1 as double), 9) as e1 from net""",
    **FEAT, **MODEL, **_sage())

PROXY = {
    "proxy": """
select a.account_id, least(coalesce(marked, 0), 4) / 4 as p, least(coalesce(n, 0), 100) / 100 as a
from accounts a left join (select account_id, count(*) filter (is_fraud) as marked, count(*) as n from moves group by account_id) m
  on m.account_id = a.account_id""",
}
add("node_metrics", """
select 'auc_roc' as metric, round((sum(r) filter (is_fraud) - count(*) filter (is_fraud) * (count(*) filter (is_fraud) + 1) / 2)
       / (count(*) filter (is_fraud) * count(*) filter (not is_fraud)), 6) as value
from (select is_fraud, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as r from proxy join lab using (account_id)) z
union all
select 'precision', round(coalesce(count(*) filter (is_fraud and a > 0.5) / nullif(count(*) filter (a > 0.5), 0), 0), 6) from proxy join lab using (account_id)
union all
select 'recall', round(coalesce(count(*) filter (is_fraud and a > 0.5) / nullif(count(*) filter (is_fraud), 0), 0), 6) from proxy join lab using (account_id)""",
    **LABELS, **PROXY)

# --- anomalies and explanations -------------------------------------------------------------------

_STEPS = {
    **dict.fromkeys(("total_sent_30d", "total_received_30d", "avg_txn_amount", "max_single_txn", "std_txn_amount"), 100),
    "velocity_7d": 0.01, "night_txn_ratio": 0.01,
}
STEPPED = {
    **FEAT, **FILLED,
    "pts": "select *, min(account_id) over (partition by " + ", ".join(_BEHAVIOUR) + ") as site from (select account_id, " + ", ".join(
        f"round({c} / {_STEPS.get(c, 1)}::double) as {c}" for c in _BEHAVIOUR) + " from filled) z",
}
add("lof", """
select p.account_id, round(-(l.around / 20) / q.density, 6) as lof_score
from pts p
join (select u.id, sum(t.density) as around from lookup u join fitted t on t.id = u.other group by u.id) l on l.id = p.account_id
join (select u.id, 1 / (sum(greatest(u.d, k.kd)) / 20 + 1e-10) as density from lookup u join kdist k on k.id = u.other group by u.id) q
  on q.id = p.account_id""", **STEPPED,
    dist="select x.account_id as id, y.account_id as other, x.site <> y.site as apart, y.site as place, sqrt("
         + " + ".join(f"(x.{c} - y.{c}) ** 2" for c in _BEHAVIOUR) + ") as d from pts x, pts y",
    lookup="select id, other, d from dist qualify row_number() over (partition by id order by apart, d, place, other) <= 20",
    others="select id, other, d from dist where id <> other qualify row_number() over (partition by id order by apart, d, place, other) <= 20",
    kdist="select id, max(d) as kd from others group by id",
    fitted="select o.id, 1 / (sum(greatest(o.d, k.kd)) / 20 + 1e-10) as density from others o join kdist k on k.id = o.other group by o.id")

add("neighbour_recall", """
select count(*) filter (id <> other) as wanted, true as enough from (
  select id, other, sum(w) over (partition by id order by id <> other, d, other rows between unbounded preceding and 1 preceding) as before
  from (select x.account_id as id, y.account_id as other, n.w, sqrt(""" + " + ".join(f"(x.{c} - y.{c}) ** 2" for c in _BEHAVIOUR) + """) as d
        from pts x join pts y on x.account_id = x.site and y.account_id = y.site
        join (select site, count(*) as w from pts group by site) n on n.site = y.account_id) z
) l where coalesce(before, 0) < 21""", **STEPPED)

add("forest_contributions", f"select account_id, cast({len(_BEHAVIOUR)} as bigint) as features, true as adds_up from feat", **FEAT)

add("anomaly_ensemble", """
select account_id, cast(-txn_count_30d as double) as iso_score, cast(-account_age_days as double) as lof_score,
       -txn_count_30d < (select quantile_cont(cast(-txn_count_30d as double), 0.08) from feat) as iso_is_anomaly,
       -account_age_days < (select quantile_cont(cast(-account_age_days as double), 0.08) from feat) as lof_is_anomaly,
       round(s, 9) as ensemble_anomaly_score, s > 0.65::double as ensemble_is_anomaly
from (select *, 0.6::double * coalesce((txn_count_30d - min(txn_count_30d) over ()) / nullif(max(txn_count_30d) over () - min(txn_count_30d) over (), 0), 0)
        + 0.4::double * coalesce((account_age_days - min(account_age_days) over ()) / nullif(max(account_age_days) over () - min(account_age_days) over (), 0), 0) as s
      from feat) z""", **FEAT)

_WEIGHTS = {
    "total_sent_30d": 0.000002, "txn_count_30d": -0.03, "account_age_days": 0.0005, "velocity_7d": 1.5,
    "unique_counterparties_30d": 0.07, "days_since_last_txn": -0.2,
}
add("top_contributions", """
select account_id, rank, feature, round(share, 4) as shap_value, case when share > 0 then 'increases_risk' else 'decreases_risk' end as direction
from (select account_id, feature, share, row_number() over (partition by account_id order by abs(share) desc, place) as rank from shares) z
where rank <= 5""", **FEAT, shares=" union all ".join(
    f"select account_id, '{c}' as feature, {i} as place, {w}::double * (coalesce({c}, 0) - avg(coalesce({c}, 0)) over ()) as share from feat"
    for i, (c, w) in enumerate(_WEIGHTS.items())))

add("readable_features", """
select account_id, feature, case feature when 'account_age_days' then 'Account age' when 'txn_count_30d' then 'Transaction frequency'
       when 'total_sent_30d' then '30-day outflow' else 'Largest single transaction' end
       || case when abs(v) > 10 then ' is ' || printf('%.0f', v) else ' = ' || printf('%.2f', v) end
       || case when v > 100 then ' (increases risk)' else ' (decreases risk)' end as readable
from (select account_id, unnest(['account_age_days', 'txn_count_30d', 'total_sent_30d', 'max_single_txn']) as feature,
             unnest([cast(account_age_days as double), cast(txn_count_30d as double), total_sent_30d, max_single_txn]) as v from feat) z""", **FEAT)

# --- risk and alerts ------------------------------------------------------------------------------

RISK = {
    **FOUND, **PROXY,
    "hits": "select account_id, pattern, count(*) as n from involved group by all",
    "rul": """
select account_id, least(100, cast(sum(n * case pattern when 'CIRCULAR_ROUND_TRIP' then 40 when 'LAYERING' then 35 when 'STRUCTURING' then 30
       when 'DORMANT_ACTIVATION' then 25 else 20 end) as double)) as rule_score,
       array_to_string(list(pattern order by list_position(['CIRCULAR_ROUND_TRIP','LAYERING','STRUCTURING','DORMANT_ACTIVATION','PROFILE_MISMATCH'], pattern)), ',') as triggered_patterns
from hits group by account_id""",
    "parts": """
select p.account_id, 0.4::double * p * 100 as gnn, 0.35::double * a * 100 as iso, 0.25::double * coalesce(rule_score, 0) as rul,
       coalesce(triggered_patterns, '') as triggered_patterns from proxy p left join rul r on r.account_id = p.account_id""",
    "scored": """
select account_id, round(total, 2) as risk_score, case when total >= 76 then 'CRITICAL' when total >= 56 then 'HIGH' when total >= 31 then 'MEDIUM' else 'LOW' end as risk_tier,
       round(gnn, 2) as gnn_contribution, round(iso, 2) as iso_contribution, round(rul, 2) as rule_contribution, triggered_patterns
from (select *, least(greatest(gnn + iso + rul, 0), 100) as total from parts) z""",
    "advised": """
select *, case risk_tier when 'CRITICAL' then 'Freeze account immediately and file STR with FIU-IND.'
   when 'HIGH' then 'Immediate review required. Escalate to senior investigator.'
   when 'MEDIUM' then 'Enhanced due diligence. Monitor closely for 30 days.' else 'Normal monitoring. No immediate action required.' end as recommendation
from scored""",
    "alrt": """
select account_id, risk_score, risk_tier, triggered_patterns, recommendation, 'OPEN' as status,
  case when said = '' then 'Account flagged based on aggregate risk signals.' else said end as evidence_summary
from (select *, concat_ws(' ',
    case when gnn_contribution > 10 then 'GNN model indicates ' || printf('%.0f', gnn_contribution) || '% structural risk from account neighbourhood.' end,
    case when iso_contribution > 10 then 'Anomaly detection score contributes ' || printf('%.0f', iso_contribution) || '% — behavioral patterns deviate from baseline.' end,
    case when triggered_patterns <> '' then 'AML patterns detected: ' || replace(triggered_patterns, ',', ', ') || '.' end) as said
  from advised where risk_tier <> 'LOW') z""",
    "recent": """
select account_id, place, txn_id, amount, txn_type, ts, counterparty, is_fraud from (
  select *, row_number() over (partition by account_id order by ts desc, txn_id, counterparty, dir) as place from moves) z where place <= 10""",
}
add("rule_scores", "select * from rul", True, **RISK)
add("risk_scores", "select * from advised", True, **RISK)
add("tier_counts", """
select t.risk_tier, count(s.account_id) as accounts from (select unnest(['LOW','MEDIUM','HIGH','CRITICAL']) as risk_tier) t
left join scored s on s.risk_tier = t.risk_tier group by t.risk_tier""", True, **RISK)
add("risk_flags", "select account_id, round(risk_score / 100, 4) as risk_score, risk_tier in ('HIGH', 'CRITICAL') as is_flagged from scored", True, **RISK)
add("alerts", "select * from alrt", True, **RISK)
STREAMED = {**RISK, **{k: v.replace("$AS_OF", "(select max(ts) from transfers)") for k, v in {**STRUCT, **PROF}.items()}}
add("stream_alerts", """
select account_id, risk_score, risk_tier, triggered_patterns, evidence_summary from alrt
where risk_score > 40 and account_id in (select account_id from moves)""", True, **STREAMED)
LIVE = ("2024-01-30 00:00:00", "2024-01-30 12:00:00", "2024-02-01 00:00:00")


def live_batch(number: int) -> str:
    """Alerts of one batch: all five rules as of its latest transfer, for the accounts it touches."""
    since, until = (f"timestamp '{t}'" for t in LIVE[number:number + 2])
    seen = f"(select max(ts) from transfers where ts < {until})"
    rules = {k: v.replace("$AS_OF", seen) for k, v in FOUND.items()}
    return composed(f"""
select cast({number} as integer) as batch_id, account_id, risk_score, risk_tier, triggered_patterns, evidence_summary from alrt
where risk_score > 40 and account_id in (select account_id from moves where ts >= {since} and ts < {until})""", True, **{**RISK, **rules})


ORACLE["stream_alerts_live"] = "\nunion all\n".join(f"select * from ({live_batch(n)}) b{n}" for n in (0, 1)).replace("$AS_OF", AS_OF)
add("alert_page", """
select account_id, risk_score, risk_tier, status, (select count(*) from alrt where risk_tier = 'MEDIUM') as total,
       30 < (select count(*) from alrt where risk_tier = 'MEDIUM') as has_more
from alrt where risk_tier = 'MEDIUM' order by risk_score desc, account_id limit 20 offset 10""", True, **RISK)
ORACLE["alert_page_stored"] = ORACLE["alert_page"]
add("alert_stats", """
select 'overall' as section, 'total_alerts' as item, cast(count(*) as double) as value from alrt
union all select 'overall', 'total_amount_at_risk', round(coalesce(sum(risk_score * 10000) filter (risk_tier in ('HIGH', 'CRITICAL')), 0), 2) from alrt
union all select 'by_tier', t.risk_tier, cast(count(s.account_id) as double) from (select unnest(['LOW','MEDIUM','HIGH','CRITICAL']) as risk_tier) t
  left join alrt s on s.risk_tier = t.risk_tier group by t.risk_tier
union all select 'top_patterns', item, cast(count(*) as double) from (
  select unnest(string_split(triggered_patterns, ',')) as item from alrt where triggered_patterns <> '') z group by item""", True, **RISK)
add("alert_detail", """
select x.account_id, x.risk_tier, customer_name, kyc_status, txn_ids, round(gnn_contribution / 40, 4) as gnn_fraud_prob, round(iso_contribution / 35, 4) as anomaly_score
from alrt x join scored s on s.account_id = x.account_id join accounts a on a.account_id = x.account_id
left join (select account_id, array_to_string(list(txn_id order by place), ',') as txn_ids from recent group by account_id) r on r.account_id = x.account_id""",
    True, **RISK)
add("alert_updates", """
select x.account_id, coalesce(l.status, 'OPEN') as status, coalesce(l.note, '') as analyst_note,
       coalesce(strftime(timestamp '2024-01-01 00:00:00' + to_seconds(l.k), '%Y-%m-%d %H:%M:%S'), '') as updated_at
from alrt x left join (
  select account_id, arg_max(status, o_orderkey) as status, max(o_orderkey) as k,
         arg_max('note ' || o_orderkey, o_orderkey) filter (o_orderkey % 3 <> 0) as note
  from (select concat('ACC', lpad(cast(o_custkey as varchar), 10, '0')) as account_id, cast(o_orderkey as integer) as o_orderkey,
        case o_orderpriority when '1-URGENT' then 'ESCALATED' when '2-HIGH' then 'INVESTIGATING' when '3-MEDIUM' then 'DISMISSED'
             when '5-LOW' then 'OPEN' end as status from orders) o where status is not null group by account_id) l
on l.account_id = x.account_id""", True, **RISK)
add("account_lookup", """
select account_id, account_type, customer_name, customer_category, branch_code, kyc_status, cast(account_age_days as bigint) as account_age_days, risk_score, is_flagged
from (select distinct dst as account_id from transfers) d left join accounts using (account_id)""")
add("recent_transfers", "select account_id, place, txn_id, amount, txn_type, counterparty, is_fraud from recent", recent=RISK["recent"])
ORACLE["recent_transfers_kept"] = ORACLE["recent_transfers"]
add("narratives", """
select x.account_id, concat_ws(' ', 'Account ' || x.account_id || ' is flagged ' || risk_tier || ' (score: ' || printf('%.0f', risk_score) || '/100).',
  case when p > 0.5 then 'The GNN model indicates ' || printf('%.0f', p * 100) || '% fraud probability based on account neighbourhood analysis.' end,
  case when a > 0.5 then 'Anomaly detection score: ' || printf('%.2f', a) || ' — behavioral patterns deviate significantly from baseline.' end,
  case when triggered_patterns <> '' then 'AML patterns triggered: ' || replace(replace(replace(replace(replace(replace(triggered_patterns, ',', ', '),
    'CIRCULAR_ROUND_TRIP', 'circular round-tripping'), 'LAYERING', 'fund layering through intermediaries'),
    'STRUCTURING', 'structuring (transactions below ₹50,000 threshold)'), 'DORMANT_ACTIVATION', 'dormant account sudden activation'),
    'PROFILE_MISMATCH', 'profile mismatch (high-value credits to low-income profile)') || '.' end,
  case risk_tier when 'CRITICAL' then 'Recommendation: Freeze account immediately and file STR with FIU-IND.'
    when 'HIGH' then 'Recommendation: Immediate review by senior investigator required.' end) as narrative
from alrt x join proxy q on q.account_id = x.account_id""", True, **RISK)
add("report_rows", """
select x.account_id, customer_name, branch_code, printf('%.0f', x.risk_score) || '/100' as risk_score, x.risk_tier,
       replace(triggered_patterns, ',', ', ') as patterns, evidence_summary as evidence, '31-01-2024' as report_date,
       '31-01-2024 00:00 IST' as signed, coalesce(r.lines, '') as transactions
from alrt x join accounts a on a.account_id = x.account_id
left join (select account_id, array_to_string(list(substr(txn_id, 1, 12) || '... ₹' || format('{:,.2f}', amount) || ' ' || txn_type || ' '
       || strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || substr(counterparty, 1, 13) || case when is_fraud then ' YES' else ' NO' end order by place), '; ') as lines
  from recent group by account_id) r on r.account_id = x.account_id""", True, **RISK)
add("run_summary", """
select 'gnn_auc_roc' as metric, round((sum(r) filter (is_fraud) - count(*) filter (is_fraud) * (count(*) filter (is_fraud) + 1) / 2)
       / (count(*) filter (is_fraud) * count(*) filter (not is_fraud)), 4) as value
from (select is_fraud, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 as r from proxy join lab using (account_id)) z
union all select 'gnn_precision', round(coalesce(count(*) filter (is_fraud and p > 0.5) / nullif(count(*) filter (p > 0.5), 0), 0), 4) from proxy join lab using (account_id)
union all select 'gnn_recall', round(coalesce(count(*) filter (is_fraud and p > 0.5) / nullif(count(*) filter (is_fraud), 0), 0), 4) from proxy join lab using (account_id)
union all select 'anomalies_flagged', count(*) filter (a > 0.65) from proxy
union all select 'patterns_CIRCULAR_ROUND_TRIP', (select count(*) from cyc)
union all select 'patterns_LAYERING', (select count(*) from lay)
union all select 'patterns_STRUCTURING', (select count(*) from stru)
union all select 'patterns_DORMANT_ACTIVATION', (select count(*) from dorm)
union all select 'patterns_PROFILE_MISMATCH', (select count(*) from prof)
union all select 'patterns_TOTAL', (select count(*) from cyc) + (select count(*) from lay) + (select count(*) from stru) + (select count(*) from dorm) + (select count(*) from prof)
union all select 'alerts_critical', count(*) filter (risk_tier = 'CRITICAL') from alrt
union all select 'alerts_high', count(*) filter (risk_tier = 'HIGH') from alrt
union all select 'alerts_medium', count(*) filter (risk_tier = 'MEDIUM') from alrt
union all select 'total_alerts', count(*) from alrt""", True, **RISK, **LABELS)
add("loaded_counts", "select (select count(*) from scored) as accounts_loaded, (select count(*) from alrt) as alerts_generated", True, **RISK)

# --- streams --------------------------------------------------------------------------------------

add("stream_inbox", """
select feed, txn_type, count(*) as transfers, sum(amount) as amount from transfers, (select unnest(['mobile', 'branch']) as feed) f group by all""")
add("stream_dedup", "select txn_id, src, dst, amount, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from transfers")
add("stream_enriched", """
select txn_id, src, customer_name, kyc_status, amount from transfers left join accounts on account_id = src""")
add("stream_structuring", """
select src, strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, strftime(w + interval 1 day, '%Y-%m-%d %H:%M:%S') as window_end,
       count(*) as transfers, max(amount) as largest, sum(amount) as total
from (select src, amount, unnest(generate_series(date_trunc('hour', ts) - interval 23 hour, date_trunc('hour', ts), interval 1 hour)) as w from transfers) z
where w + interval 1 day <= (select max(ts) from transfers) - interval 10 minute
group by src, w having count(*) >= 2 and max(amount) < 49999""")
add("stream_sessions", """
select src, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, strftime(max(ts) + interval 6 hour, '%Y-%m-%d %H:%M:%S') as session_end,
       count(*) as transfers, sum(amount) as total
from (select *, sum(fresh) over (partition by src order by ts, txn_id) as s from (
  select src, ts, txn_id, amount, case when ts >= lag(ts) over (partition by src order by ts, txn_id) + interval 6 hour then 1 else 0 end as fresh from transfers) y) z
group by src, s having max(ts) + interval 6 hour <= (select max(ts) from transfers) - interval 10 minute""")
add("stream_history", """
select src, count(*) as transfers, sum(amount) as total, max(amount) as largest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts
from transfers group by src""")
