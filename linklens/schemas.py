"""Declared schemas of the tables; nothing is inferred from data.

Identity: evidence (task_id, page_url, domain, seq), where seq is the scan position in
its page; domains (task_id, domain); tickets (task_id, domain, page_url).  The `id`
columns are hashes of these for listing and look-up; no join relies on them alone.
"""

RESPONSES = ("task_id INT, url STRING, status_code INT, content_type STRING, html STRING, "
             "response_time_ms INT, error STRING, fetched_at TIMESTAMP")
TASKS = ("task_id INT, name STRING, target_url STRING, status STRING, config STRING, pages_crawled INT, "
         "pages_total INT, external_domains_count INT, subdomains_count INT, current_url STRING, "
         "started_at TIMESTAMP, finished_at TIMESTAMP, error_message STRING, created_at TIMESTAMP")
SITEMAP_PAGES = ("id BIGINT, task_id INT, url STRING, path STRING, depth INT, status_code INT, content_type STRING, "
                 "title STRING, response_time_ms INT, external_domains_count INT, error STRING, crawled_at TIMESTAMP")
EXTERNAL_DOMAINS = ("id BIGINT, task_id INT, domain STRING, root_domain STRING, occurrence_count BIGINT, has_link BOOLEAN, "
                    "has_text BOOLEAN, sample_page_url STRING, risk_level STRING, risk_tags ARRAY<STRING>, "
                    "risk_remark STRING, risk_source STRING, verify_status STRING, verify_time TIMESTAMP, "
                    "verify_detail STRING, created_at TIMESTAMP")
SUBDOMAINS = ("id BIGINT, task_id INT, domain STRING, root_domain STRING, occurrence_count BIGINT, has_link BOOLEAN, "
              "has_text BOOLEAN, sample_page_url STRING, created_at TIMESTAMP")
OCCURRENCES = ("id BIGINT, task_id INT, domain STRING, root_domain STRING, page_url STRING, page_title STRING, seq BIGINT, "
               "source_type STRING, raw_match STRING, context_snippet STRING, is_link BOOLEAN, created_at TIMESTAMP")
TASK_LOGS = "id BIGINT, task_id INT, level STRING, message STRING, created_at TIMESTAMP"
RISK_PROFILES = ("id INT, domain STRING, match_type STRING, risk_level STRING, category STRING, tags ARRAY<STRING>, "
                 "source STRING, remark STRING, created_at TIMESTAMP, updated_at TIMESTAMP")
TICKETS = ("id BIGINT, task_id INT, domain STRING, root_domain STRING, page_url STRING, page_title STRING, "
           "source_type STRING, raw_match STRING, context_snippet STRING, risk_level STRING, risk_tags ARRAY<STRING>, "
           "risk_remark STRING, verify_status STRING, last_verified_at TIMESTAMP, last_verify_detail STRING, "
           "manual_status STRING, manual_remark STRING, created_at TIMESTAMP, updated_at TIMESTAMP")
