"""Row types of fragments and canonical records."""

LOCATION = "struct<raw:string,city:string,region:string,country:string,country_code:string>"
LINKS = "struct<linkedin:string,github:string,portfolio:string,other:array<string>>"
EMAIL = "struct<value:string,normalized:string,confidence:double,evidence_ids:array<string>>"
PHONE = "struct<raw:string,e164:string,confidence:double,evidence_ids:array<string>>"
SKILL = "struct<name:string,original_names:array<string>,category:string,parent_category:string,confidence:double,sources:array<string>,evidence_ids:array<string>>"
EXPERIENCE = f"struct<company:string,company_canonical:string,title:string,title_canonical:string,start:date,end:date,summary:string,location:{LOCATION},confidence:double,evidence_ids:array<string>>"
EDUCATION = "struct<institution:string,degree:string,degree_canonical:string,field:string,start_year:int,end_year:int,confidence:double,evidence_ids:array<string>>"
EVIDENCE = "struct<evidence_id:string,field:string,original:string,canonical:string,method:string,rule:string,confidence:double>"
FIELDS = {
    "external_id": "string", "source": "string", "record_id": "string", "source_file": "string", "quality": "double", "raw_hash": "string", "full_name": "string", "headline": "string", "years_experience": "double",
    "location": LOCATION, "links": LINKS, "emails": f"array<{EMAIL}>", "phones": f"array<{PHONE}>", "skills": f"array<{SKILL}>", "experience": f"array<{EXPERIENCE}>", "education": f"array<{EDUCATION}>", "evidence": f"array<{EVIDENCE}>",
}
#: What a source yields for one record, as JSON and as a type.
PARSED = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"
FRAGMENT = "frag_ord bigint, frag_id string, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items())
CANONICAL = (
    "candidate_id string, full_name string, emails array<{e}>, phones array<{p}>, location {l}, links {k}, headline string, years_experience double, skills array<{s}>, experience array<{x}>, education array<{d}>, overall_confidence double"
).format(e=EMAIL, p=PHONE, l=LOCATION, k=LINKS, s=SKILL, x=EXPERIENCE, d=EDUCATION)
