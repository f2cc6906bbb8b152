"""Explicit schemas of the engine's inputs and tables, as DDL."""

PAGES = "doc_id string, page_number int, text string"
CASE_METADATA = "case_id string, title string, citation string, decision_date string, year int, judge string, description string, path string"
PARAGRAPH = "struct<paragraph_number:int,page_start:int,page_end:int,text:string>"
_ITEM = "array<struct<label:string,text:string>>"
ACT = (
    "act struct<act_id:string,name:string,short_name:string,year:int,status:string,predecessor_act:string,successor_act:string,jurisdiction:string>, "
    "sections array<struct<section_id:string,section_number:string,title:string,text:string,predecessor_act:string,successor_act:string,"
    f"subsections:array<struct<section_id:string,subsection_number:string,text:string>>,explanations:{_ITEM},illustrations:{_ITEM},exceptions:{_ITEM},provisos:{_ITEM},legal_concepts:array<string>>>"
)
CORRESPONDENCE = "mapping struct<mapping_id:string,source_act:string,target_act:string,mapping_type:string>, mappings array<struct<mapping_id:string,source_section:string,target_section:string,relationship:string>>"
JUDGMENT_CHUNK = (
    "chunk_id string, case_id string, document_type string, chunk_type string, topic_heading string, text string, source struct<field:string,paragraphs:array<int>,parent_paragraph:int,sub_part:string,page_start:int,page_end:int>, "
    "related_paragraphs array<int>, legal_references array<string>, legal_concepts array<string>, cited_cases array<string>, token_count int"
)
STATUTE_CHUNK = (
    "chunk_id string, act_id string, section_id string, document_type string, chunk_type string, text string, source struct<section_number:string,has_main_text:boolean,subsections:array<string>,explanations:array<string>,illustrations:array<string>,exceptions:array<string>,provisos:array<string>>, "
    "legal_references array<string>, legal_concepts array<string>, successor_references array<string>, predecessor_references array<string>, token_count int"
)
NODES = "id string, label string, name string"
EDGES = "src string, dst string, type string"
GOLD = "id string, query string, expected_targets array<string>, category string"
