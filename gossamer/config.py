"""Settings of every operator, and their YAML form (sections stages.<section> and pipeline)."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any


class ConfigurationError(ValueError):
    """A configuration that is missing, unreadable or out of range."""


# Defaults that results depend on.
SCHEMES = ["http", "https"]
BLOCKED_EXTENSIONS = [
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".zip", ".tar", ".gz", ".rar", ".7z", ".mp3", ".mp4",
    ".avi", ".mov", ".wmv", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".exe", ".dmg", ".pkg", ".deb", ".rpm",
]
SKIPPED_SCHEMES = ["mailto:", "tel:", "javascript:", "data:", "ftp:", "file:", "about:"]
RETRIED_STATUS = [429, 500, 502, 503, 504]
AGENT = "MyWebCrawler/1.0"


@dataclass
class UrlRules:
    allowed_domains: list[str] = field(default_factory=list)
    blocked_domains: list[str] = field(default_factory=list)
    max_depth: int = 3
    allowed_schemes: list[str] = field(default_factory=lambda: list(SCHEMES))
    blocked_extensions: list[str] = field(default_factory=lambda: list(BLOCKED_EXTENSIONS))
    normalize_urls: bool = True


@dataclass
class DedupRules:
    method: str = "set"
    bloom_capacity: int = 1_000_000
    bloom_error_rate: float = 0.01
    database_path: str = "data/seen_urls.db"
    case_sensitive: bool = False


@dataclass
class RobotsRules:
    user_agent: str = AGENT
    respect_robots_txt: bool = True
    cache_ttl_hours: int = 24
    default_on_error: str = "allow"
    timeout_seconds: int = 10
    max_retries: int = 2  # accepted, without effect


@dataclass
class RateRules:
    default_delay_seconds: float = 1.0
    max_concurrent_per_domain: int = 1  # accepted, without effect
    respect_crawl_delay: bool = True
    global_rate_limit: int | None = None
    burst_size: int = 5
    strategy: str = "fixed"


@dataclass
class FetchRules:
    timeout_seconds: int = 30
    max_retries: int = 3
    max_redirects: int = 5  # accepted, without effect
    verify_ssl: bool = True
    user_agent: str = AGENT
    max_content_size_mb: int = 10
    use_headless_browser: bool = False
    browser_type: str = "chromium"
    wait_for_selector: str | None = None
    page_load_delay: float = 1.0
    accept_language: str = "en-US,en;q=0.9"
    accept_encoding: str = "gzip, deflate"
    retry_backoff_factor: float = 2.0
    retry_on_status: list[int] = field(default_factory=lambda: list(RETRIED_STATUS))
    pool_connections: int = 10
    pool_maxsize: int = 20


@dataclass
class ParseRules:
    parser: str = "html.parser"
    extract_metadata: bool = True
    extract_open_graph: bool = True
    extract_twitter_card: bool = True
    extract_canonical: bool = True
    extract_language: bool = True
    handle_malformed_html: bool = True  # accepted, without effect
    strip_javascript: bool = True
    strip_comments: bool = True
    max_html_size_mb: int = 5


@dataclass
class LinkRules:
    extract_anchor_text: bool = True
    extract_images: bool = True
    extract_stylesheets: bool = False
    extract_scripts: bool = False
    follow_iframes: bool = False
    ignore_fragments: bool = True
    ignore_query_params: bool = False
    skip_schemes: list[str] = field(default_factory=lambda: list(SKIPPED_SCHEMES))
    skip_extensions: list[str] = field(default_factory=list)  # accepted, without effect
    same_domain_only: bool = False
    max_links_per_page: int = 1000


@dataclass
class ContentRules:
    method: str = "simple"
    min_text_length: int = 100
    remove_boilerplate: bool = True
    extract_headings: bool = True
    extract_paragraphs: bool = True
    extract_lists: bool = True
    extract_tables: bool = False
    normalize_whitespace: bool = True
    remove_extra_newlines: bool = True
    decode_html_entities: bool = True
    min_paragraph_length: int = 20
    max_content_length: int = 1_000_000


@dataclass
class StorageRules:
    storage_type: str = "sqlite"
    database_path: str = "data/crawler.db"
    postgres_host: str = "localhost"
    postgres_port: int = 5432
    postgres_database: str = "crawler"
    postgres_user: str = "crawler"
    postgres_password: str = ""
    output_directory: str = "data/pages"
    store_html: bool = True
    store_text: bool = True
    store_metadata: bool = True
    store_links: bool = True
    batch_size: int = 100  # accepted, without effect
    compress_html: bool = True
    create_indexes: bool = True
    on_conflict: str = "replace"


@dataclass
class FollowRules:
    max_depth: int = 3
    max_total_pages: int = 10_000
    same_domain_only: bool = False
    prioritize_shallow_pages: bool = True  # always so here
    auto_stop: bool = True  # accepted, without effect
    stop_on_max_pages: bool = True


#: Keys that a file may not set.
CODE_ONLY = {
    "url_validation": {"normalize_urls"},
    "fetch": {"accept_encoding", "retry_on_status"},
    "link_extraction": {"skip_schemes", "skip_extensions"},
    "content_extraction": {"decode_html_entities"},
    "storage": {"create_indexes"},
}


@dataclass
class CrawlConfig:
    url_validation: UrlRules = field(default_factory=UrlRules)
    duplicate_detection: DedupRules = field(default_factory=DedupRules)
    robots: RobotsRules = field(default_factory=RobotsRules)
    rate_limiting: RateRules = field(default_factory=RateRules)
    fetch: FetchRules = field(default_factory=FetchRules)
    parse: ParseRules = field(default_factory=ParseRules)
    link_extraction: LinkRules = field(default_factory=LinkRules)
    content_extraction: ContentRules = field(default_factory=ContentRules)
    storage: StorageRules = field(default_factory=StorageRules)
    link_reinjection: FollowRules = field(default_factory=FollowRules)
    # Worker counts are accepted; Spark's partitions and cores take their place.
    queue_size: int = 1000
    url_validation_workers: int = 2
    duplicate_detection_workers: int = 2
    robots_validation_workers: int = 2
    rate_limiting_workers: int = 3
    fetch_workers: int = 10
    parse_workers: int = 3
    link_extraction_workers: int = 2
    content_extraction_workers: int = 2
    storage_workers: int = 2
    link_reinjection_workers: int = 2


SECTIONS = {f.name: f.default_factory for f in fields(CrawlConfig) if not isinstance(f.default, int)}


def from_dict(data: dict[str, Any]) -> CrawlConfig:
    """Every key optional, unknown keys ignored, null lists their default."""
    stages, out = data.get("stages") or {}, {}
    for name, kind in SECTIONS.items():
        given = stages.get(name) or {}
        known = {f.name for f in fields(kind)} - CODE_ONLY.get(name, set())
        lists = {f.name for f in fields(kind) if str(f.type).startswith("list")}
        out[name] = kind(**{k: v for k, v in given.items() if k in known and not (v is None and k in lists)})
    sizes = {f.name for f in fields(CrawlConfig)} - set(SECTIONS)
    out |= {k: v for k, v in (data.get("pipeline") or {}).items() if k in sizes}
    return CrawlConfig(**out)


def load_yaml(path: str) -> CrawlConfig:
    import yaml

    try:
        data = yaml.safe_load(Path(path).read_text())
    except OSError as e:
        raise ConfigurationError(f"can't read {path}: {e}") from e
    except yaml.YAMLError as e:
        raise ConfigurationError(f"{path} is no YAML: {e}") from e
    if not data or not isinstance(data, dict):
        raise ConfigurationError(f"{path} is empty")
    return from_dict(data)


def to_dict(config: CrawlConfig) -> dict[str, Any]:
    everything = asdict(config)
    return {"pipeline": {k: v for k, v in everything.items() if k not in SECTIONS}, "stages": {k: everything[k] for k in SECTIONS}}


def save_yaml(config: CrawlConfig, path: str) -> None:
    import yaml

    try:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(yaml.safe_dump(to_dict(config), sort_keys=False))
    except OSError as e:
        raise ConfigurationError(f"can't write {path}: {e}") from e


def validate(config: CrawlConfig) -> bool:
    for ok, what in (
        (config.fetch_workers >= 1, "fetch_workers must be 1 or more"),
        (config.queue_size >= 10, "queue_size must be 10 or more"),
        (config.url_validation.max_depth >= 0, "url_validation.max_depth must not be negative"),
        (config.link_reinjection.max_depth >= 0, "link_reinjection.max_depth must not be negative"),
    ):
        if not ok:
            raise ConfigurationError(what)
    return True


def overridden(config: CrawlConfig, depth: int | None = None, pages: int | None = None, domains: list[str] | None = None, agent: str | None = None, delay: float | None = None) -> CrawlConfig:
    """config with what the command line sets; depth and agent each set two keys."""
    if depth is not None:
        config.url_validation.max_depth = config.link_reinjection.max_depth = depth
    if pages is not None:
        config.link_reinjection.max_total_pages = pages
    if domains:
        config.url_validation.allowed_domains = list(domains)
    if agent:
        config.robots.user_agent = config.fetch.user_agent = agent
    if delay is not None:
        config.rate_limiting.default_delay_seconds = delay
    return config
