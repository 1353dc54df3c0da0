"""Explicit schemas of the tables between stages, and default sizes."""

PAGE_META = "struct<source_file:string,total_pages:int,title:string,document_id:string,version:string,effective_date:string,issued_by:string,issued_to:string,page_type:string,has_table:boolean,char_count:int>"
PAGES = f"doc string, page int, text string, metadata {PAGE_META}"
RAW_PAGES = "doc string, page int, text string"
TABLE_INFO = "array<struct<columns:array<string>,rows:int,row_split:boolean>>"
CHUNK_META = f"struct<source_file:string,title:string,document_id:string,version:string,effective_date:string,pages:array<int>,char_count:int,has_table:boolean,tables:{TABLE_INFO},char_start:int,char_end:int,params:map<string,int>>"
CHUNKS = f"chunk_id string, doc string, chunking_strategy string, section string, page_start int, page_end int, text string, embedding_text string, metadata {CHUNK_META}"
TOKEN_INFO = "struct<token_count:int,max_seq_length:int,truncated:boolean,embedded_chars:int>"
VECTORS = f"{CHUNKS}, embedding_model string, embedding_dim int, embedding array<float>, token_info {TOKEN_INFO}"
LINE = "struct<x0:double,y0:double,x1:double,y1:double,text:string>"
TABLE = "struct<bbox:struct<x0:double,y0:double,x1:double,y1:double>,rows:array<array<string>>>"
LAYOUT = f"file string, page int, raw_text string, blocks array<struct<lines:array<{LINE}>>>, tables array<{TABLE}>"
DOCUMENTS = "doc string, source_file string, template string, total_pages int, extracted_pages array<int>, skipped_pages array<int>, metadata struct<title:string,document_id:string,version:string,effective_date:string,issued_by:string,issued_to:string,approvals:map<string,string>,revision_history:array<struct<rev_no:string,description:string,rev_date:string,effective_date:string>>>"
REGISTRY = "file string, name string, template string, cover_page int, skip_pages array<int>"

CHUNK_SIZE, CHUNK_OVERLAP, SECTION_MOST, TABLE_MOST = 500, 50, 1200, 1000
STRATEGIES, PRIMARY, TOP_K, SHORT = ("fixed", "recursive", "section"), "section", 5, 150
PAGE_GAP = "\n\n"
