"""Site rules: where a source's pages keep listings, chapters and descriptions. They are configuration; pass your own for other sites."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Listing:
    """Rows of a search or feed page. A field is a selector inside the row; with `cells`, author and latest are numbers of table cells, and rows without three cells go by `other`, if there is one."""

    items: str
    title: str
    author: str = ""
    description: str = ""
    latest: str = ""
    cover: str = "img"
    rating: str = ""
    cells: tuple[int, int] | None = None
    least_title: int = 1
    other: Listing | None = None


@dataclass(frozen=True)
class Chapters:
    """Links of a chapter list; hrefs with a refused word are left out before repeats are."""

    links: str
    refused: tuple[str, ...] = ()
    least_title: int = 2


@dataclass(frozen=True)
class Info:
    title: str
    author: str = ".author, .book-author"
    description: str = ".intro, .description, .summary"
    cover: str = ".book-cover img, .cover img"
    status: str = ".status, .book-status"
    rating: str = ".rating, .score, .stars"
    word_count: str = ".word-count, .words"
    categories: str = ".category a, .tag a, .cate a"
    labelled: str = ""  # paragraphs that begin with a label give author and status


@dataclass(frozen=True)
class Site:
    source: str
    base_url: str
    search: Listing | None = None
    feed: Listing | None = None
    chapters: Chapters = field(default_factory=lambda: GENERIC_CHAPTERS)
    info: Info = field(default_factory=lambda: GENERIC_INFO)


# Selectors, refused words, labels and headings.
GENERIC_CHAPTERS = Chapters("ul li a, .chapter-list a, .book-chapter a, #chapters a, [class*='chapter'] a", ("login", "register", "search", "profile"))
GENERIC_INFO = Info("h1")
SITES = (
    Site(
        "ixdzs8", "https://ixdzs8.com",
        Listing(".u-list li, .book-item, .search-result", "h3 a, h2 a, .title a", ".author, .book-author", ".desc, .description, .intro", ".latest-chapter, .last-chapter", "img.cover, img.book-cover, .cover img", ".rating, .score, .stars"),
        Listing(".burl, .u-list li, .book-item", "h3 a, h2 a, .title a, .bname a", ".author, .book-author, .bauthor a", ".desc, .description, .intro, .l-p2", "", "img", ".rating, .score, .stars"),
        Chapters(".chapter-list a, .dir-con a, ul li a"), Info("h1.book-title, h1.title"),
    ),
    Site(
        "xbiquge", "https://www.xbiquge.info",
        Listing("#maincontent tr, .grid tr, .bookbox", "td a", cells=(1, 3), other=Listing(".bookbox", ".bookname a", ".author", "", ".cat a")), Listing("#maincontent tr, .grid tr", "td a", cells=(1, 9)),
        Chapters("#list dd a, .chapter-list a", least_title=1), Info("#info h1", author="", status="", description="#intro", cover="#fmimg img", word_count="", categories=".category a, .tag a", labelled="#info p"),
    ),
    Site(
        "biquge_company", "https://www.biquge.company",
        Listing(".bookbox, .bookinfo", ".bookname a", ".author", ".update", ".cat a"), Listing(".bookbox, .bookinfo", "h3 a, h2 a, .title a", ".author"),
        info=Info("h1.book-title, h1.title"),
    ),
    Site(
        "ttkan", "https://www.ttkan.co",
        Listing(".novel_cell, [data-v-2ba0104b] .pure-g > div", "h3 a, .bookname a, a[title]", ".author", cover="img.book-cover, img.cover, .cover img", rating=".rating, .score, .stars", least_title=2),
        Listing(".novel_cell, [data-v-2ba0104b] .pure-g > div", "h3 a, .title a, a[title]", ".author", rating=".rating, .score"),
        Chapters("a[href*='/novel/pagea/']", least_title=1), Info("h1.novel-title, h1.title", ".author-info", ".novel-intro, .description", ".book-cover img, .cover img, img.book-cover", "", word_count=""),
    ),
    Site(
        "shuhaige", "https://m.shuhaige.net",
        Listing(".list li, .book-item, .search-result", ".bookname a, h3 a, .book-title a", ".data a, .author", "", ".data a:last-child", "img.book-cover, img.cover, .cover img"), Listing(".list li, .book-item", "h3 a, .title a", ".author"),
        Chapters(".booklist dd a, .chapter-list a, ul li a", ("login", "register", "search")), Info("h1.book-title, h1.title"),
    ),
)
LABELS = {"author": "作者：", "status": "状态："}
RELATED = ".recommendations, .similar-books, .related-novels"
RELATED_HEADINGS = ("推荐", "在看", "相关", "similar", "recommend")
RELATED_ITEMS, RELATED_TITLE, RELATED_MOST = "li, .book-item, .novel-item", "a[title], h3 a, .title a", 10
LIST_PAGES = ".pagelist select option"
DIRECTORY_LABEL = "目录"
#: The links of the further pages of a chapter list, how many such pages count, and from how many chapters a book needs no directory page.
LISTED = Chapters(".read li a", ("login", "register", "search"))
LISTED_MOST, ENOUGH_CHAPTERS = 5, 10
BOOK_PATHS = ("/book/", "/novel/", "/read/")
NEXT, PREVIOUS = ("next", "下一"), ("prev", "上一")
