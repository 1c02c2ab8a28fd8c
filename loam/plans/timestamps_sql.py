"""The instants of event dates in SQL: the oracle of problem 3, and of what builds on it."""

from __future__ import annotations

from loam.operators.timestamps import BACK, BACK_DECADE, LATER, MONTHS, READINGS, SWITCH, ZONES

_MONTHS = ", ".join(f"('{name}', {n})" for n, names in MONTHS.items() for name in names)
_ZONES = ", ".join(f"('{z}', {h * 3600})" for z, h in ZONES.items())
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d{1,9})?)?\s*([AaPp][Mm])?"
_ZONE = r"\s*([A-Za-z]{1,5}|[+-]\d{1,2}(?::?\d{2})?)?(?:\[[A-Za-z_/+-]+\])?"


def _family(pattern: str, names: list[str], family: str) -> str:
    cols = ", ".join(f"nullif(e.{n}, '') {n}" if n in names else f"null {n}" for n in ("y", "mo", "d", "h", "mi", "s", "ap", "z"))
    lst = ", ".join(f"'{n}'" for n in names)
    return f"select ingest_id, '{family}' fam, {cols} from (select ingest_id, regexp_extract(v, '{pattern}', [{lst}]) e from txt where regexp_matches(v, '{pattern}'))"


#: Common table expressions ending in ``instants (ingest_id, u, f)``: every possible instant of every row and the format it is read in; and ``days (ingest_id, dd)``.
INSTANTS_SQL = f"""txt as (select ingest_id, trim(eventDate) v from heracleum_ua_clean where eventDate is not null),
months as (select * from (values {_MONTHS}) m(name, n)), zones as (select * from (values {_ZONES}) z(name, off)),
parts as ({_family(rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:(?:[Tt]|,?\s+){_TIME}{_ZONE})?$", ["y", "mo", "d", "h", "mi", "s", "ap", "z"], "ymd")}
 union all {_family(rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]\d{{1,9}})?{_ZONE})?$", ["y", "mo", "d", "h", "mi", "s", "z"], "compact")}
 union all {_family(rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:(?:[Tt]|,?\s+){_TIME}{_ZONE})?$", ["d", "mo", "y", "h", "mi", "s", "ap", "z"], "dotted")}
 union all {_family(rf"^(\d{{1,2}})\.?\s+(\pL+)\.?,?\s+(\d{{4}})(?:,?\s+{_TIME}{_ZONE})?$", ["d", "mo", "y", "h", "mi", "s", "ap", "z"], "day_name")}
 union all {_family(rf"^(\pL+)\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_TIME}{_ZONE})?$", ["mo", "d", "y", "h", "mi", "s", "ap", "z"], "name_day")}),
dated as (select p.*, try_cast(lpad(y, 4, '0') || '-' || lpad(coalesce(cast(n as varchar), mo), 2, '0') || '-' || lpad(d, 2, '0') as date) dd from parts p left join months on months.name = lower(mo)),
days as (select ingest_id, dd from dated where h is null and dd is not null),
timed as (select ingest_id, case fam when 'dotted' then 'dmy' else fam end f, epoch(dd) + case lower(ap) when 'am' then cast(h as bigint) % 12 when 'pm' then cast(h as bigint) % 12 + 12 else cast(h as bigint) end * 3600 + cast(mi as bigint) * 60 + cast(coalesce(s, '0') as bigint) w, lower(z) z
  from dated where dd is not null and h is not null and cast(h as bigint) between (case when ap is null then 0 else 1 end) and (case when ap is null then 23 else 12 end) and cast(mi as bigint) <= 59 and cast(coalesce(s, '0') as bigint) <= 59),
offs as (select ingest_id, f, w, z, case when regexp_matches(z, '^[+-]') then (case when z[1] = '-' then -1 else 1 end) * (cast(regexp_extract(z, '^[+-](\\d{{1,2}}?):?(\\d{{2}})?$', 1) as bigint) * 3600 + cast(coalesce(nullif(regexp_extract(z, '^[+-](\\d{{1,2}}?):?(\\d{{2}})?$', 2), ''), '0') as bigint) * 60) else off end east from timed left join zones on zones.name = z),
instants as (select ingest_id, cast(w - east as bigint) u, f from offs where z is not null and east is not null
 union select ingest_id, u, f from (select ingest_id, f, w, cast(w - k * 3600 as bigint) u from offs, (values (1), (2), (3), (4)) t(k) where z is null) where epoch(timezone('Europe/Kyiv', to_timestamp(u))) = w
 union select ingest_id, e.u, e.f from (select ingest_id, unnest([struct_pack(u := try_cast(v as bigint), f := 'epoch_s'), struct_pack(u := try_cast(v as bigint) // 1000, f := 'epoch_ms')]) e from txt where regexp_matches(v, '^\\d{{9,18}}$')) where e.u >= 883612800 and e.u < 1735689600)"""

FOUND_SQL = f"with {INSTANTS_SQL} select ingest_id, min(u) utc_second from instants group by 1 having count(distinct u) = 1"

_FORMATS = ", ".join(f"('{name}', {i})" for i, name in enumerate(READINGS))
#: All rows with status, instant and format: a Viterbi pass per source that carries whole paths along, row by row.
CHOSEN_SQL = f"""with recursive {INSTANTS_SQL}, formats as (select * from (values {_FORMATS}) t(f, n)),
o as (select ingest_id, datasetKey, list(struct_pack(u := u, n := n) order by u, n) z, count(distinct u) n_instants from instants join formats using (f) join (select ingest_id, datasetKey from heracleum_ua_clean) using (ingest_id) group by 1, 2),
r as (select *, row_number() over (partition by datasetKey order by ingest_id) rn from o),
v as (select datasetKey, rn, ingest_id, z, list_transform(range(1, len(z) + 1), lambda j: struct_pack(c := cast(case when j > 1 then {LATER} * (j - 1) + ((ingest_id % 997) * 331 + (ingest_id // 997 % 991) * 101 + (j - 1) * 577) % 997 else 0 end as bigint), p := [j])) s from r where rn = 1
 union all select r.datasetKey, r.rn, r.ingest_id, r.z, list_transform(range(1, len(r.z) + 1), lambda j: list_sort(list_transform(range(1, len(v.z) + 1), lambda i: struct_pack(c := cast(v.s[i].c + case when v.z[i].n = r.z[j].n then 0 else {SWITCH} end
   + case when r.z[j].u < v.z[i].u then {BACK} + cast(round({BACK_DECADE} * log10(1 + (v.z[i].u - r.z[j].u) / 86400.0)) as bigint) else 0 end + case when j > 1 then {LATER} * (j - 1) + ((r.ingest_id % 997) * 331 + (r.ingest_id // 997 % 991) * 101 + (j - 1) * 577) % 997 else 0 end as bigint),
   p := list_append(v.s[i].p, j))))[1]) from v join r on r.datasetKey is not distinct from v.datasetKey and r.rn = v.rn + 1),
best as (select datasetKey, list_sort(s)[1].p p from v qualify row_number() over (partition by datasetKey order by rn desc) = 1),
pick as (select ingest_id, z[p[rn]].u u, z[p[rn]].n n, n_instants from r join best on r.datasetKey is not distinct from best.datasetKey)
select ingest_id, h.datasetKey, eventDate, case when n_instants = 1 then 'instant' when n_instants > 1 then 'chosen' when dd is not null then 'day' else 'none' end status, u utc_second, formats.f format, cast(coalesce(n_instants, 0) as integer) n_instants, case when n_instants is null then dd end "day"
from heracleum_ua_clean h left join pick using (ingest_id) left join formats using (n) left join (select ingest_id, min(dd) dd from days group by 1) using (ingest_id)"""
