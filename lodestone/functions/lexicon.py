"""Word lists of the legal domain: abbreviations, authorities, pronouns, stop words, question patterns."""

from __future__ import annotations

#: Abbreviations and their full names, in order; a later name for the same abbreviation would win.
ABBREVIATIONS = (
    # constitutional laws
    ("RF", "Regeringsformen"), ("TF", "Tryckfrihetsförordningen"), ("YGL", "Yttrandefrihetsgrundlagen"), ("SO", "Successionsordningen"), ("RO", "Riksdagsordningen"),
    # civil codes
    ("JB", "Jordabalken"), ("ÄB", "Ärvdabalken"), ("GB", "Giftermålsbalken"), ("FB", "Föräldrabalken"), ("HB", "Handelsbalken"), ("SjöL", "Sjölagen"), ("UB", "Utsökningsbalken"),
    # criminal codes
    ("BrB", "Brottsbalken"), ("RB", "Rättegångsbalken"), ("BrP", "Brottsdatalagen"),
    # public law
    ("FL", "Förvaltningslagen"), ("FPL", "Förvaltningsprocesslagen"), ("KL", "Kommunallagen"), ("OSL", "Offentlighets- och sekretesslagen"), ("SekrL", "Sekretesslagen"),
    ("LOA", "Lagen om offentlig anställning"), ("LOU", "Lagen om offentlig upphandling"), ("LUF", "Lagen om upphandling inom försörjningssektorerna"),
    # data protection
    ("GDPR", "Dataskyddsförordningen"), ("PuL", "Personuppgiftslagen"), ("DSL", "Dataskyddslagen"), ("LEK", "Lagen om elektronisk kommunikation"),
    # labour law
    ("LAS", "Lagen om anställningsskydd"), ("MBL", "Medbestämmandelagen"), ("AML", "Arbetsmiljölagen"), ("SemL", "Semesterlagen"), ("ATL", "Arbetstidslagen"), ("DiskrL", "Diskrimineringslagen"),
    # tax law
    ("IL", "Inkomstskattelagen"), ("ML", "Mervärdesskattelagen"), ("SFL", "Skatteförfarandelagen"), ("SBL", "Skattebetalningslagen"), ("ABL", "Aktiebolagslagen"),
    ("BFL", "Bokföringslagen"), ("ÅRL", "Årsredovisningslagen"), ("KonkL", "Konkurslagen"),
    # social law
    ("SoL", "Socialtjänstlagen"), ("LSS", "Lagen om stöd och service till vissa funktionshindrade"), ("LVU", "Lagen med särskilda bestämmelser om vård av unga"),
    ("LVM", "Lagen om vård av missbrukare"), ("HSL", "Hälso- och sjukvårdslagen"), ("PSL", "Patientsäkerhetslagen"), ("SFB", "Socialförsäkringsbalken"),
    # environmental law
    ("MB", "Miljöbalken"), ("PBL", "Plan- och bygglagen"), ("PBF", "Plan- och byggförordningen"), ("ExprL", "Expropriationslagen"),
    # migration law
    ("UtlL", "Utlänningslagen"), ("MedbL", "Medborgarskapslagen"), ("LMA", "Lagen om mottagande av asylsökande"),
    # other laws
    ("AvtL", "Avtalslagen"), ("KöpL", "Köplagen"), ("KKL", "Konsumentköplagen"), ("SkL", "Skadeståndslagen"), ("PreskrL", "Preskriptionslagen"), ("URL", "Upphovsrättslagen"),
    ("VML", "Varumärkeslagen"), ("PatL", "Patentlagen"), ("TL", "Trafikskadelagen"), ("FAL", "Försäkringsavtalslagen"), ("BankL", "Bankrörelselagen"),
    # law of the European Union
    ("FEUF", "Fördraget om Europeiska unionens funktionssätt"), ("FEU", "Fördraget om Europeiska unionen"),
    ("EKMR", "Europakonventionen om de mänskliga rättigheterna"), ("EU-stadgan", "Europeiska unionens stadga om de grundläggande rättigheterna"),
    # courts and authorities
    ("HD", "Högsta domstolen"), ("HFD", "Högsta förvaltningsdomstolen"), ("RegR", "Regeringsrätten"), ("JO", "Justitieombudsmannen"), ("JK", "Justitiekanslern"),
    ("DO", "Diskrimineringsombudsmannen"), ("SKV", "Skatteverket"), ("IMY", "Integritetsskyddsmyndigheten"), ("ARN", "Allmänna reklamationsnämnden"),
    # kinds of documents
    ("prop", "proposition"), ("mot", "motion"), ("bet", "betänkande"), ("SOU", "Statens offentliga utredningar"), ("Ds", "Departementsserien"), ("SFS", "Svensk författningssamling"),
    ("NJA", "Nytt juridiskt arkiv"), ("RÅ", "Regeringsrättens årsbok"),
)

#: Abbreviations that count as laws when entities are extracted.
LAW_NAMES = (
    "GDPR", "OSL", "RF", "TF", "YGL", "PuL", "BrB", "ÄB", "FB", "SekrL", "FörvL", "KL", "SoL", "LVU", "LVM", "HSL", "PSL", "MBL", "LAS", "AML", "SFB", "PBL", "MB",
)

#: Authorities that are found anywhere in a text.
AUTHORITIES = (
    "IMY", "Datainspektionen", "Riksdagen", "Regeringen", "Regeringskansliet", "Justitiedepartementet", "Socialdepartementet", "Finansdepartementet", "Skatteverket",
    "Försäkringskassan", "Arbetsförmedlingen", "Migrationsverket", "Polismyndigheten", "Åklagarmyndigheten", "Domstolsverket", "Socialstyrelsen", "Folkhälsomyndigheten",
    "IVO", "Konsumentverket", "Konkurrensverket", "Naturvårdsverket",
)

#: Type of an entity, its pattern, its confidence, in order of extraction; then laws and authorities.
ENTITY_PATTERNS = (("sfs", r"(\d{4}:\d+)", 1.0), ("kapitel", r"(?i)(\d+)\s*kap\.?", 0.95), ("paragraf", r"(\d+)\s*§", 0.95))
LAW_CONFIDENCE, AUTHORITY_CONFIDENCE, NAMED_LAW_CONFIDENCE = 0.9, 0.85, 0.95

#: Which type of entity stands for a pronoun, best first.
ENTITY_PRIORITY = ("lag", "myndighet", "sfs", "kapitel", "paragraf")

#: Pronouns that refer to an earlier turn.
PRONOUNS = ("den", "det", "dessa", "denna", "dette", "de", "dem", "hans", "hennes", "dess", "deras", "här", "där", "detta")

#: Words that a lexical query leaves out.
LEXICAL_STOPWORDS = (
    "och", "i", "att", "det", "som", "en", "på", "är", "av", "för", "med", "till", "den", "har", "de", "inte", "om", "ett", "kan", "ska", "jag", "vi", "du", "vad", "hur",
    "när", "var", "vilka", "finns", "eller", "men", "så", "nu", "bara", "alla", "också", "efter", "vid", "från", "ut", "upp", "in", "över", "sin", "säger", "enligt", "gäller", "berätta",
)

#: Words that a paraphrase leaves out.
PARAPHRASE_STOPWORDS = (
    "vad", "hur", "när", "var", "vilka", "vilken", "vilket", "är", "finns", "gäller", "säger", "innebär", "betyder", "om", "i", "på", "för", "med", "av", "till", "den", "det",
    "och", "eller", "som", "att", "kan", "ska", "måste",
)

#: Question patterns and what they become; $1 and $2 are their groups.
QUESTION_PATTERNS = (
    (r"^vad säger (.+?) om (.+)\?*$", "$1 $2"), (r"^hur fungerar (.+)\?*$", "$1 funktioner egenskaper"), (r"^vilka (.+?) finns i (.+)\?*$", "$2 $1"),
    (r"^vad är (.+)\?*$", "$1 definition betydelse"), (r"^när gäller (.+)\?*$", "$1 tillämpning ikraftträdande"), (r"^vem ansvarar för (.+)\?*$", "$1 ansvar myndighet"),
)

#: The first two words of context of each law that a paraphrase adds.
CONTEXT_WORDS = (
    ("GDPR", "dataskydd personuppgifter"), ("OSL", "sekretess offentlighet"), ("RF", "grundlag regeringsform"), ("TF", "tryckfrihet yttrandefrihet"), ("YGL", "yttrandefrihet media"),
    ("LAS", "anställning uppsägning"), ("PBL", "bygglov detaljplan"),
)
