"""Table schemas as DDL, and the shapes of the nested feeds."""

from __future__ import annotations

IDENTIFIERS = "array<struct<type:string,identifier:string>>"

TABLES = {
    "users": "user_id int, identity_user_id string, first_name string, last_name string, username string",
    "identities": "id string, user_name string, email string",
    "book_entries": (
        "entry_id long, user_id int, isbn10 string, isbn13 string, source string, source_book_id string, title string, authors string, thumbnail_url string, page_count int, status string, "
        "pages_completed int, percent_completed int, rating decimal(38,18), user_review string, user_internal_review string, start_date timestamp, end_date timestamp, created_date timestamp, updated_date timestamp"
    ),
    "entry_requests": (
        "request_id long, ts timestamp, user_id int, entry_id long, source string, source_book_id string, title string, authors string, thumbnail_url string, isbn10 string, isbn13 string, status string, "
        "page_count int, pages_completed int, percent_completed int"
    ),
    "reading_goals": "reading_goal_id long, user_id int, year int, target_book_count int, updated_date timestamp",
    "catalog_batches": "batch_id int, genre_slug string, status string, created_at timestamp, published_at timestamp, created_by string",
    "catalog_books": (
        "book_row_id int, batch_id int, section string, position int, isbn13 string, source_book_id string, title string, authors array<string>, description string, cover_url string, publisher string, "
        f"identifiers {IDENTIFIERS}, published_date string, release_date date"
    ),
    "book_metadata": (
        "isbn13 string, source_book_id string, title string, authors array<string>, description string, cover_url string, cover_override_url string, publisher string, "
        f"identifiers {IDENTIFIERS}, published_date string, provider string, retrieved_at timestamp"
    ),
    "api_request_logs": (
        "log_id decimal(20,0), started_at timestamp, api_name string, direction string, method string, route string, status_code int, duration_ms double, actor_type string, actor_id string, "
        "query_parameter_names string, client_ip string, user_agent string, trace_id string, error_type string, error_message string"
    ),
}

VOLUME_INFO = (
    "struct<title:string,subtitle:string,authors:array<string>,description:string,publisher:string,publishedDate:string,pageCount:int,language:string,categories:array<string>,"
    f"imageLinks:struct<smallThumbnail:string,thumbnail:string>,industryIdentifiers:{IDENTIFIERS}>"
)
VOLUMES = f"items array<struct<id:string,volumeInfo:{VOLUME_INFO}>>"
BESTSELLERS = (
    "status string, results struct<bestsellers_date:string,lists:array<struct<display_name:string,books:array<struct<title:string,author:string,description:string,publisher:string,primary_isbn10:string,"
    "primary_isbn13:string,book_image:string,weeks_on_list:int,age_group:string,contributor:string,contributor_note:string,amazon_product_url:string,created_date:string,buy_links:array<struct<name:string,url:string>>>>>>>"
)
OPEN_WORKS = "docs array<struct<key:string,title:string,author_name:array<string>,isbn:array<string>,cover_i:int,first_publish_year:int,readinglog_count:int>>"
LIBRARY_BOOKS = (
    "isbn string, title string, key string, authors array<struct<name:string>>, publishers array<struct<name:string>>, cover struct<large:string,medium:string>, "
    "identifiers struct<isbn_10:array<string>,isbn_13:array<string>>, publish_date string"
)
AUTHOR_SUMMARIES = "title string, extract string, content_urls struct<desktop:struct<page:string>>, thumbnail struct<source:string,width:int,height:int>"
