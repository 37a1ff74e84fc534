"""Fixed values of the news desk: patterns (any letter case), trusted domains, stop words, synonyms."""

#: Patterns of the relevance test.
STRONG = [
    r"\baksj(?:e|en|er|ene|ekurs|emarked)\b",
    r"\bbørs(?:en|er|ene|notert|melding)?\b",
    r"\b(oslo børs|euronext|wall street|nasdaq|s&p 500|dow jones|stoxx|dax)\b",
    r"\b(resultat|resultater|kvartalstall|årsresultat|driftsresultat|ebitda|ebit|guiding|resultatvarsel|earnings|revenue|sales|profit|net income|eps|guidance|forecast|outlook|margin|free cash flow|quarterly results|annual results)\b",
    r"\b(beats? estimates|miss(?:es|ed)? estimates|above estimates|below estimates|raises? guidance|cuts? guidance|profit warning)\b",
    r"\b(oppkjøp|fusjon|bud|budplikt|overtakelse|acquisition|merger|takeover)\b",
    r"\b(emisjon|kapitalinnhenting|fortrinnsrett|rights issue|tilbakekjøp|utbytte)\b",
    r"\b(kursmål|kjøpsanbefaling|salgsanbefaling|analytiker|meglerhus|oppgradering|nedgradering)\b",
    r"\b(rente|renter|rentekutt|renteheving|styringsrente|rentemøte|interest rate|rate cut|rate hike)\b",
    r"\b(inflasjon|kpi|cpi|pce|prisvekst|kjerneinflasjon)\b",
    r"\b(valuta|krone|norske kroner|nok\b|eur\/nok|usd\/nok|dollar|euro)\b",
    r"\b(obligasjon|obligasjoner|bond|bonds|yield|statsrente|kredittspread|kreditt)\b",
    r"\b(brent|oljepris|olje|gasspris|naturgass|opec)\b",
    r"\b(shipping|tørrbulk|tankrater|fraktrater|offshore)\b",
    r"\b(laks|sjømat|salmon)\b",
    r"\b(bank|banker|bankene|finansiering|refinansiering|gjeld|lån|likviditet)\b",
    r"\b(kontrakt|ordre|ordrebok|avtaleverdi|milliardkontrakt)\b",
    r"\b(konkurs|rekonstruksjon|betalingsstans|insolvens|bankruptcy|restructuring|default|chapter 11)\b",
    r"\b(shares? (?:surge|jump|soar|rally|plunge|slump|tumble|drop)|stock (?:surges?|jumps?|soars?|plunges?|slumps?|tumbles?)|selloff|record high|record low)\b",
    r"\b(10-q|10-k|8-k|6-k|20-f|sec filing|annual report|quarterly report)\b",
    r"\b(fed|federal reserve|ecb|esb|norges bank|bank of england)\b",
    r"\b(bnp|gdp|pmi|arbeidsledighet|ledighet|sysselsetting|nonfarm|jobbtall|lønnsvekst)\b",
    r"\b(handelstoll|tollsatser|tariff|sanksjoner)\b",
    r"\b(bitcoin|ethereum|krypto|crypto)\b",
    r"\b(ai chips?|semiconductor|semiconductors|data center|datacenter|gpu|foundry)\b",
    r"\b(ipo|initial public offering|market cap|market value|buyback|share repurchase|dividend)\b",
]
COMPANY = [
    r"\b(nvidia|apple|microsoft|alphabet|google|amazon|meta|tesla|broadcom|amd|oracle|salesforce|netflix)\b",
    r"\b(tsmc|taiwan semiconductor|asml|samsung electronics|sony|toyota|softbank)\b",
    r"\b(jpmorgan|goldman sachs|morgan stanley|bank of america|citigroup|wells fargo|hsbc|ubs|deutsche bank)\b",
    r"\b(berkshire hathaway|exxon|chevron|shell|bp|totalenergies|aramco)\b",
    r"\b(novo nordisk|eli lilly|roche|novartis|astrazeneca|pfizer|merck)\b",
    r"\b(airbus|boeing|lvmh|hermes|volkswagen|mercedes-benz|bmw|siemens|sap)\b",
]
ATTENTION = [
    r"\b(billion|milliard|trillion|record|rekord|largest|biggest|største|historic|historisk)\b",
    r"\b(surge|soar|jump|plunge|slump|tumble|rally|selloff|kollaps|stuper|skyter fart)\b",
    r"\b(ceo|cfo|founder|grunnlegger|resigns?|steps down|går av|fired|sparket)\b",
    r"\b(profit warning|guidance cut|guidance raise|beats estimates|misses estimates|unexpected|uventet)\b",
]
BROAD = [
    r"\bøkonomi(?:en|sk|ske)?\b",
    r"\bmarked(?:et|er|ene)?\b",
    r"\bnæringsliv\b",
    r"\bbedrift(?:er|ene)?\b",
    r"\bselskap(?:et|er|ene)?\b",
    r"\binvestor(?:er|ene)?\b",
    r"\binvestering(?:er|ene)?\b",
    r"\bskatt(?:e|en|er|ene)?\b",
    r"\bbudsjett\b",
    r"\benergi(?:pris|priser|marked)?\b",
    r"\bråvare(?:r|marked)?\b",
    r"\beiendom(?:smarked|spris|spriser)?\b",
]
NOISE = [
    r"\b(reise|reisemål|ferie|helgetur|hotellguide|restaurant|oppskrift|mat og drikke)\b",
    r"\b(fotball|landslaget|premier league|champions league|sport)\b",
    r"\b(kjendis|film|tv-serie|musikk|podkast-stjerne|podcast-stjerne)\b",
    r"\b(skole|elever|lærer|pisa)\b",
]

#: Patterns, domains and stop words of triage.
TRIAGE_MAJOR_COMPANY = [
    r"\b(nvidia|apple|microsoft|alphabet|google|amazon|meta|tesla|broadcom|amd|oracle|netflix|salesforce)\b",
    r"\b(tsmc|taiwan semiconductor|asml|samsung electronics|softbank|toyota)\b",
    r"\b(novo nordisk|eli lilly|roche|novartis|astrazeneca|pfizer|merck)\b",
    r"\b(jpmorgan|goldman sachs|morgan stanley|bank of america|citigroup|ubs|hsbc|deutsche bank)\b",
    r"\b(berkshire hathaway|exxon|chevron|shell|bp|totalenergies|aramco|boeing|airbus|lvmh|sap)\b",
    r"\b(equinor|dnb|telenor|yara|kongsberg gruppen|aker bp|mowi|salmar|norsk hydro|orkla|gjensidige)\b",
]
TRIAGE_MAJOR_FIGURE = [
    r"\b(warren buffett|jerome powell|christine lagarde|jamie dimon|larry fink|ray dalio|howard marks)\b",
]
TRIAGE_CORPORATE_FINANCE = [
    r"\b(quarterly results|quarterly earnings|earnings report|earnings call|annual results|årsresultat|kvartalstall|resultatrapport)\b",
    r"\b(revenue|sales growth|net income|operating profit|ebitda|ebit|eps|free cash flow|margin|omsetning|driftsresultat|resultat per aksje)\b",
    r"\b(profit warning|cuts? guidance|raises? guidance|guidance cut|guidance raise|outlook cut|outlook raised|resultatvarsel)\b",
    r"\b(acquisition|takeover|merger|buyout|oppkjøp|fusjon|bud på|overtakelse)\b",
    r"\b(ipo|capital raise|rights issue|share issue|emission|emisjon|buyback|share repurchase|tilbakekjøp|dividend|utbytte)\b",
    r"\b(bankruptcy|chapter 11|default|restructuring|insolvency|konkurs|rekonstruksjon|betalingsstans)\b",
    r"\b(contract worth|order worth|order backlog|major contract|kontrakt verdt|milliardkontrakt|ordrebok)\b",
]
TRIAGE_MARKET_MACRO = [
    r"\b(federal reserve|\bfed\b|fomc|ecb|european central bank|bank of japan|\bboj\b|bank of england|norges bank)\b",
    r"\b(rate cut|rate hike|interest rate decision|policy rate|rentekutt|renteheving|styringsrente|rentebeslutning)\b",
    r"\b(inflation|\bcpi\b|\bpce\b|nonfarm|payrolls|jobs report|unemployment|\bgdp\b|\bpmi\b|inflasjon|kpi|jobbtall|arbeidsledighet|bnp)\b",
    r"\b(brent|crude oil|opec|oil price|natural gas|gold price|copper price|oljepris|gasspris)\b",
    r"\b(s&p 500|nasdaq|dow jones|stoxx 600|oslo børs|euronext|wall street)\b",
    r"\b(bitcoin|ethereum|crypto market|kryptomarked)\b",
    r"\b(yield|bond market|treasury yield|statsrente|obligasjonsmarked|credit spread)\b",
    r"\b(tariffs?|sanctions?|trade war|tollsatser|sanksjoner)\b",
    r"\b(tax|taxes|budget|fiscal policy|regulation|skatt|skatter|budsjett|statsbudsjett|finanspolitikk|regulering)\b",
]
TRIAGE_BASIC_FINANCE = [
    r"\b(aksje|aksjen|aksjer|børs|analytiker|kursmål|meglerhus|investor|utbytte|obligasjon|valuta|krone|dollar|euro)\b",
    r"\b(stock|shares?|analyst|price target|investor|dividend|bond|currency|dollar|euro|market cap)\b",
    r"\b(shipping|tanker|dry bulk|offshore|rigg|rigs?|salmon|laks|semiconductor|chip|chips|oil|olje|natural gas|gass)\b",
]
TRIAGE_MARKET_MOVE = [
    r"\b(shares?|stock)\s+(?:surge|jump|soar|rally|plunge|slump|tumble|drop|fall|rise)s?\b",
    r"\b(record high|record low|all-time high|selloff|market rally|stuper|skyter fart|rekordhøy)\b",
    r"\b(up|down)\s+\d+(?:[.,]\d+)?\s*%\b",
]
TRIAGE_ATTENTION = [
    r"\b(billion|trillion|milliard|billion-dollar|largest|biggest|record|historic|rekord|største|historisk)\b",
    r"\b(ceo|cfo|chairman|founder|grunnlegger)\b.*\b(resigns?|steps down|fired|sparket|går av)\b",
    r"\b(unexpected|surprise|uventet|overrasker)\b",
]
TRIAGE_NOISE = [
    r"\b(teacher|teachers|student|students|school|museum|museums|medical students?|specialty choice|education guidance|career guidance)\b",
    r"\b(reise|ferie|restaurant|recipe|oppskrift|football|soccer|premier league|sport|celebrity|kjendis|movie|film|music|musikk)\b",
    r"\b(human remains guidance|certification investigations|research integrity|practice guidance)\b",
]
TRUSTED_DOMAINS = (
    "reuters.com ft.com cnbc.com wsj.com bloomberg.com bbc.com apnews.com finance.yahoo.com yahoo.com dn.no e24.no finansavisen.no "
    "economist.com federalreserve.gov ecb.europa.eu boj.or.jp norges-bank.no ssb.no sec.gov live.euronext.com newsweb.no "
).split()
TRIAGE_STOP = (
    "the and for with from after before into over under about says "
    "say new amid of to in on at as a an is "
    "are was were be by its it this that og for med "
    "fra etter før over under om til av i på er som "
    "en et den det shares share stock stocks market markets company companies "
    "selskaper selskap aksjen aksjer "
).split()

#: Patterns of the audience test.
AUDIENCE_NORWEGIAN = r"\b(norge|norsk\w*|norway|norwegian|oslo børs|osebx|norges bank|kronekurs\w*|nok|equinor|dnb|kongsberg|aker|yara|mowi|salmar|telenor|orkla|norsk hydro|vår energi|var energi|frontline|hafnia|subsea 7|ssb)\b"
AUDIENCE_GLOBAL = r"\b(fed|fomc|federal reserve|ecb|esb|brent|opec|oil|olje|gas|gass|nvidia|apple|microsoft|alphabet|amazon|meta|tesla|novo nordisk|s&p\s*500|nasdaq|bitcoin|btc|ethereum|inflasjon|inflation|us payrolls|tariffs|tollsatser)\b"
AUDIENCE_EVENT = r"\b(resultat\w*|earnings|guid\w*|revenue|rate\w*|rent\w*|cut\w*|hik\w*|hever|senker|oppkjøp|acqui\w*|merger|kontrakt\w*|contract\w*|inflasjon|inflation|stiger|faller|surge\w*|plunge\w*|sanction\w*|tariff\w*|toll\w*|billion|milliard\w*|konkurs|bankrupt\w*|payroll\w*)\b"
AUDIENCE_NOISE = r"\b(sponsored|advertorial|horoscope|horoskop|giveaway|coupon|kupong|best stocks to buy|stocks to buy now)\b"

#: The reasons that the audience test gives.
REASON_NOISE = "Reklame eller generisk kjøpsliste."
REASON_VAGUE = "Ingen konkret ny økonomisk hendelse."
REASON_NORWEGIAN = "Direkte norsk økonomi- eller selskapsrelevans."
REASON_GLOBAL = "Global hendelse innen markeder norske finanslesere følger."
REASON_REACH = "Norsk eller vesentlig global publikumsrelevans er ikke dokumentert."

#: Synonyms of triage, applied in this order to lower-cased titles without marks.
TRIAGE_SYNONYMS = [
    (r"bank of japan|\bboj\b", "bankjapan"),
    (r"federal reserve|\bfed\b|\bfomc\b", "federalreserve"),
    (r"european central bank|\becb\b", "ecb"),
    (r"bank of england|\bboe\b", "bankengland"),
    (r"raises?|raised|hikes?|hiked|hever|hevet|oker|øker", " raise "),
    (r"cuts?|cutting|senker|senket|kutter|kuttet", " cut "),
    (r"earnings|quarterly results|annual results|resultater|kvartalstall", " earnings "),
    (r"acquisition|takeover|merger|oppkjop|oppkjøp|fusjon", " deal "),
    (r"guidance|outlook|forecast|prognose", " guidance "),
    (r"resigns?|steps down|gar av|går av", " resign "),
]
#: Domains that selection trusts, and types of concrete events.
SELECTION_DOMAINS = "reuters.com ft.com cnbc.com wsj.com bloomberg.com bbc.com apnews.com dn.no e24.no".split()
CONCRETE_TYPES = "resultat oppkjøp kontrakt makro renter markedsbevegelse regulatorisk".split()
#: Desks whose basic finance words count in triage, and money words beside a company.
FINANCE_DESK = r"Aksjetips|Børs og finans|Dagens Næringsliv|E24|Yahoo Finance|CNBC|WSJ|Financial Times|Reuters|Bloomberg"
MONEY_WORDS = r"\b(revenue|profit|eps|margin|guidance|shares?|stock|deal|acquisition|earnings|results?)\b"

#: Words of events, rewritten in this order, and words that events are compared without.
EVENT_SYNONYMS = [
    (r"bank of japan|\bboj\b", "bankjapan"),
    (r"federal reserve|\bfed\b|\bfomc\b", "federalreserve"),
    (r"bank of england|\bboe\b", "bankengland"),
    (r"european central bank|\becb\b", "ecb"),
    (r"raises?|raised|hikes?|hiked|lifts?|lifted|hever|hevet|oker|øker", " raise "),
    (r"cuts?|cutting|senker|senket|kutter|kuttet", " cut "),
    (r"steps? down|resigns?|resigned|gar av|går av", " resign "),
    (r"takes? over|succeeds?|overtar|tar over", " succeed "),
    (r"earnings|quarterly results|results|resultater|kvartalstall", " earnings "),
    (r"acquisition|takeover|merger|oppkjop|oppkjøp", " deal "),
    (r"guidance|outlook|forecast|prognose", " guidance "),
]
EVENT_STOP = (
    "the and for with from after into over under about says say new of to in on at as a an is are was were be by "
    "og for med fra etter over under om til av i på er som en et den det "
    "shares stock stocks market markets company selskaper aksjen aksjer"
).split()
