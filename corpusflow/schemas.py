"""Schemas of the data model, as DDL."""

REF = (
    "name string, source_url string, org string, category string, pillar string, description string, launch_date string, "
    "launch_vehicle string, country string, mass_kg string, orbit string, remarks string, extra map<string,string>, pos bigint"
)
EXTRACTION = "struct<method:string,page_count:int,full_text:string>"
STRUCTURED = "struct<launch_date:string,end_date:string,objective:string,agency:string,spacecraft:string,orbit:string,instruments:string,launch_vehicle:string,summary:string>"
RECORD = (
    "org string, mission_name string, category string, pillar string, description string, pdf_url string, pdf_checksum string, source_url string, "
    "data_source string, launch_date string, launch_vehicle string, country string, mass_kg string, orbit string, remarks string, "
    f"extraction {EXTRACTION}, structured {STRUCTURED}, scraped_at string"
)
LEVEL = "struct<question:string,answer:string>"
CHAIN = f"struct<aspect:string,level_1:{LEVEL},level_2:{LEVEL},level_3:{LEVEL}>"
QA_RESULT = f"organisation string, organization string, mission_name string, source_url string, scraped_at string, total_chains int, qa_chains array<{CHAIN}>"
MESSAGES = "array<struct<role:string,content:string>>"
SAMPLE = f"sample_id string, source_id string, mission_name string, organization string, aspect string, difficulty string, chain_id string, source_url string, messages {MESSAGES}"
STATUS = "name string, status string, method string, source string"
