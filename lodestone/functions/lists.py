"""Word lists and tables of the text, URL and HTML functions."""

#: Words that BODY drops and a query ignores.
STOP_WORDS = frozenset(
    """
    a i be de he ie me re we if of eg am an in on un co do go no so to up or as is us at it by my via inc etc
    had and ltd see she the one are due off all him can ten con own who too two top her per for nor our has
    was his its get yet not but out put you few how now six may why any cry find once made side take name same
    some mine nine done none here were fire more else have five give move each much such with both back call
    well bill fill mill will full seem them whom from than been then when even thin upon down also into onto
    keep ever over four your this hers ours less thus that what cant part last most must next thru show they
    only many very could would found third hence since three while whole noone there where these those whose
    above being along among which thick until still often again under other after never their seems yours
    eight might front hasnt least first about below every empty forty sixty indeed seemed should behind beyond
    around toward thence whence beside became become anyone before please twelve itself myself during having
    though enough detail system bottom eleven herein within rather either former latter others theirs across
    always amount cannot except anyhow anyway hereby nobody namely mostly twenty hundred someone sincere
    nowhere because himself herself nothing seeming through several between therein wherein whether neither
    whither another further whoever however whereas towards besides becomes perhaps serious couldnt amongst
    against without somehow thereby whereby already describe sometime everyone anywhere yourself anything
    becoming although hereupon together whenever wherever whatever moreover interest formerly latterly
    meanwhile somewhere elsewhere therefore otherwise something thereupon whereupon hereafter sometimes
    ourselves beforehand everywhere everything thereafter whereafter afterwards themselves yourselves
    throughout nevertheless
    """.split()
)
#: Hosts (without www.) that the URL scores trust.
TRUSTED_DOMAINS = frozenset(
    """
    un.org gov.uk ft.com npr.org edx.org bbc.com ted.com wsj.com who.int mit.edu nsa.gov usa.gov cdc.gov
    sec.gov loc.gov nih.gov ieee.org imdb.com cnbc.com time.com fool.com nasa.gov data.gov nist.gov jstor.org
    arxiv.org wired.com webmd.com apple.com europa.eu python.org github.com google.com nature.com docker.com
    forbes.com apnews.com mozilla.org tate.org.uk git-scm.com nytimes.com reuters.com history.com coursera.org
    wikipedia.org worldbank.org metmuseum.org aljazeera.com bloomberg.com goodreads.com microsoft.com
    economist.com mayoclinic.org sciencemag.org britannica.com healthline.com techcrunch.com aws.amazon.com
    khanacademy.org arstechnica.com marketwatch.com theguardian.com medlineplus.gov en.wikipedia.org
    investopedia.com britishmuseum.org stackoverflow.com scholar.google.com smithsonianmag.com
    washingtonpost.com clevelandclinic.org hopkinsmedicine.org linuxfoundation.org psychologytoday.com
    developer.android.com nationalgeographic.com pubmed.ncbi.nlm.nih.gov
    """.split()
)
TRUSTED_TLDS = frozenset("co com edu gov int net org".split())
#: Extensions that pages have; none is one too.
PAGE_EXTENSIONS = frozenset(["", "php", "htm", "html", "asp"])
#: Extensions that aren't crawled.
FILE_EXTENSIONS = frozenset(
    """
    db ai au 7z gz cr2 sr2 bz2 mp3 mp4 m4a wma mdb deb aac doc mid psd exe pdf nef gif orf ogg pkg dmg img log
    mpg svg msi avi bak apk xml sql rpm bin ico iso odp 3gp zip bmp tmp swp rar tar ods xls eps dat odt ppt
    m4v wav mkv flv wmv mov csv tsv raw flac aiff tiff mpeg webm json webp docx xlsx pptx sqlite torrent
    """.split()
)
#: Query parameters that a canonical URL lacks.
TRACKING = frozenset(
    """
    _ _t _ga sid ref _gl _gac rand gclid source random nocache referer utm_term referrer sessionid visitorid
    timestamp session_id visitor_id utm_source utm_medium utm_content utm_campaign
    """.split()
)
#: Named entities; each pair is name and text. nbsp is a plain blank.
ENTITIES = {
    'ge': '≥', 'le': '≤', 'ne': '≠', 'Pi': 'Π', 'Xi': 'Ξ', 'ni': '∋',
    'pi': 'π', 'xi': 'ξ', 'gt': '>', 'lt': '<', 'mu': 'μ', 'nu': 'ν',
    'eta': 'η', 'sub': '⊂', 'deg': '°', 'reg': '®', 'ang': '∠', 'Phi': 'Φ',
    'chi': 'χ', 'phi': 'φ', 'Psi': 'Ψ', 'psi': 'ψ', 'sum': '∑', 'yen': '¥',
    'rho': 'ρ', 'amp': '&', 'sup': '⊃', 'int': '∫', 'not': '¬', 'tau': 'τ',
    'loz': '◊', 'para': '¶', 'beta': 'β', 'zeta': 'ζ', 'iota': 'ι', 'nsub': '⊄',
    'circ': 'ˆ', 'prod': '∏', 'sube': '⊆', 'supe': '⊇', 'bull': '•', 'isin': '∈',
    'euro': '€', 'prop': '∝', 'nbsp': ' ', 'emsp': ' ', 'ensp': ' ', 'dArr': '⇓',
    'hArr': '⇔', 'lArr': '⇐', 'rArr': '⇒', 'uArr': '⇑', 'darr': '↓', 'harr': '↔',
    'larr': '←', 'rarr': '→', 'uarr': '↑', 'apos': "'", 'sect': '§', 'cent': '¢',
    'sdot': '⋅', 'quot': '"', 'part': '∂', 'copy': '©', 'Omega': 'Ω', 'omega': 'ω',
    'alpha': 'α', 'nabla': '∇', 'Sigma': 'Σ', 'sigma': 'σ', 'Gamma': 'Γ', 'gamma': 'γ',
    'kappa': 'κ', 'Theta': 'Θ', 'theta': 'θ', 'Delta': 'Δ', 'delta': 'δ', 'radic': '√',
    'pound': '£', 'trade': '™', 'tilde': '˜', 'Prime': '″', 'prime': '′', 'mdash': '—',
    'ndash': '–', 'iexcl': '¡', 'lceil': '⌈', 'rceil': '⌉', 'frasl': '⁄', 'infin': '∞',
    'notin': '∉', 'micro': 'µ', 'laquo': '«', 'raquo': '»', 'sbquo': '‚', 'bdquo': '„',
    'ldquo': '"', 'rdquo': '"', 'lsquo': "'", 'rsquo': "'", 'asymp': '≈', 'crarr': '↵',
    'clubs': '♣', 'times': '×', 'diams': '♦', 'minus': '−', 'exist': '∃', 'equiv': '≡',
    'empty': '∅', 'frac12': '½', 'frac14': '¼', 'frac34': '¾', 'Lambda': 'Λ', 'lambda': 'λ',
    'divide': '÷', 'permil': '‰', 'forall': '∀', 'curren': '¤', 'plusmn': '±', 'lsaquo': '‹',
    'rsaquo': '›', 'hellip': '…', 'thinsp': ' ', 'brvbar': '¦', 'dollar': '$', 'Dagger': '‡',
    'dagger': '†', 'lfloor': '⌊', 'rfloor': '⌋', 'spades': '♠', 'hearts': '♥', 'middot': '·',
    'iquest': '¿', 'epsilon': 'ε', 'upsilon': 'υ', 'omicron': 'ο',
}
#: Adult words in a title word or a URL.
ADULT = r"(?i)xxx|nsfw|fetish|p[0o]rn|nudes?|\bs[e3]x\b|blow[-_]?job"
