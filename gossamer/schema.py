"""Schemas of the stored tables and of what is extracted from a page."""

from __future__ import annotations

PAGE_METADATA = (
    "struct<title:string,description:string,keywords:array<string>,author:string,published_date:string,"
    "canonical_url:string,language:string,open_graph:map<string,string>,twitter_card:map<string,string>>"
)
CONTENT = (
    "struct<word_count:int,char_count:int,headings:array<struct<level:int,text:string>>,paragraphs:array<string>,"
    "lists:array<struct<type:string,items:array<string>>>,"
    "tables:array<struct<headers:array<string>,rows:array<array<string>>>>>"
)
LINKS = "array<struct<pos:int,kind:string,url:string,text:string>>"
EXTRACTED = f"struct<title:string,page_metadata:{PAGE_METADATA},links:{LINKS},text_content:string,content:{CONTENT},error:string>"

PAGES = (
    "url string, final_url string, title string, content_type string, status_code int, depth int, parent_url string, "
    "raw_html string, text_content string, word_count int, char_count int, crawled_at timestamp, metadata string"
)
LINK_ROWS = "source_url string, target_url string, anchor_text string"
IMAGE_ROWS = "page_url string, image_url string, alt_text string"
SEEN_URLS = "url string, first_seen timestamp"
CRAWL_STATS = "timestamp timestamp, pages_crawled long, links_found long, errors_count long"
RECORD = "url string, depth int, parent_url string"
ROBOTS = "domain string, status int, body string, fetched_at timestamp"
CAPTURE = "url string, status_code int, final_url string, content_type string, body string"
