"""SQL twins of ``stayloom.sources.roles`` as CTEs, with dependency order."""

from __future__ import annotations

import re

ROLE_CTES = {
    "r_stays": """select user_id subject_id, user_id hadm_id, event_id stay_id, ts intime,
        ts + (12 + event_id % 120) * interval 1 hour outtime from events where event_type = 'signup'""",
    "r_labs": """select user_id subject_id, user_id hadm_id, event_type itemid, ts charttime, value valuenum
        from events where event_type <> 'signup'""",
    "r_bedside": """select s.subject_id, s.hadm_id, s.stay_id, l.itemid, l.charttime, l.valuenum
        from r_labs l join r_stays s on s.subject_id = l.subject_id
        and l.charttime >= s.intime and l.charttime <= s.outtime""",
    "r_age": "select c_custkey subject_id, c_custkey hadm_id, 13 + c_custkey % 85 age from customer",
    "r_sepsis3": "select subject_id, stay_id, stay_id % 3 = 0 sepsis3 from r_stays where stay_id % 2 = 0",
    "r_comorb": """select c_custkey subject_id, c_custkey hadm_id, (c_nationkey % 2 = 0)::int renal_disease,
        (c_nationkey % 3 = 0)::int mild_liver_disease, (c_nationkey % 7 = 0)::int severe_liver_disease,
        (c_nationkey % 4 = 0)::int chronic_pulmonary_disease, (c_nationkey % 5 = 0)::int congestive_heart_failure,
        c_nationkey % 10 charlson_comorbidity_index from customer""",
    "r_dx": "select o_custkey subject_id, o_custkey hadm_id, o_orderpriority icd_code from orders",
    "r_soi": """select o.o_custkey subject_id, o.o_custkey hadm_id,
        case when o.o_orderkey % 3 = 0 then null else m.stay_id end stay_id,
        o.o_orderpriority || '/' || o.o_orderstatus specimen,
        timestamp '2024-01-01' + (o.o_orderkey % 720) * interval 1 hour suspected_infection_time
        from orders o left join (select subject_id, max(stay_id) stay_id from r_stays group by 1) m
        on m.subject_id = o.o_custkey""",
    "r_detail": """select subject_id, hadm_id, stay_id, intime admittime, outtime dischtime,
        case when stay_id % 4 = 0 then intime + (stay_id % 60) * interval 1 day end dod from r_stays""",
    "r_stage": """select subject_id, hadm_id, stay_id, cast(floor(valuenum) as int) % 4 aki_stage
        from r_bedside where itemid = 'click'""",
    "r_vent": """select stay_id, case stay_id % 4 when 0 then 'InvasiveVent' when 1 then 'HFNC' else 'None' end
        ventilation_status from r_stays""",
    "r_text": """select user_id patient_no, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') sample_time,
        event_type analyte, case when event_id % 11 = 0 then '测不出' when event_id % 13 = 0 then ''
        when event_id % 17 = 0 then '-' || cast(cast(value as decimal(12,2)) as varchar)
        else cast(cast(value as decimal(12,2)) as varchar) end result from events where event_type <> 'signup'""",
    "r_features": """select o.o_orderkey id, case when o.o_orderkey % 7 = 3 then null else l.f1 end f1,
        case when o.o_orderkey % 11 = 4 then null else l.f2 end f2,
        case when o.o_orderkey % 13 = 5 then null else l.f3 end f3,
        case when o.o_orderkey % 17 = 6 then null else l.f4 end f4, o.o_totalprice f5,
        cast(l.f1 + 100 * l.f3 > 31 as int) label,
        case when o.o_orderkey % 7 = 0 then 1.0::double + (o.o_orderkey % 5) end dose,
        2.0::double + (o.o_orderkey % 4) stay_day
        from orders o join (select l_orderkey, round(avg(l_quantity), 6) f1, round(avg(l_extendedprice), 6) f2,
        round(avg(l_discount), 6) f3, round(avg(l_tax), 6) f4 from lineitem group by 1) l on l.l_orderkey = o.o_orderkey""",
}


def with_roles(body: str, **extra: str) -> str:
    """Prefix ``body`` with every role (and extra CTE) it mentions, directly or through another."""
    pool = {**ROLE_CTES, **extra}
    ordered: list[str] = []
    entered: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\b\w+\b", text):
            if name in pool and name not in entered:
                entered.add(name)
                visit(pool[name])
                ordered.append(name)

    visit(body)
    if not ordered:
        return body.strip()
    return "with " + ",\n".join(f"{n} as ({pool[n].strip()})" for n in ordered) + "\n" + body.strip()
