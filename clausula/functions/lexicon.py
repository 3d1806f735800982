"""Word lists. All are fixed values that the segmentation rules depend on."""

from __future__ import annotations

import re

# Abbreviations that may end a sentence.
ENDING = "a.m. p.m. A.M. P.M. etc. ext. approx. dept. Ph.D. M.D. B.A. B.S. M.A. M.S. Ed.D. J.D. D.D.S. R.N. M.B.A. LL.B. LL.M. Inc. Corp. Ltd. Co. Bros. LLC. LLP. U.S. U.S.A. U.K. U.N. E.U. D.C.".split()
COUNTRIES = "U.S.A. U.S. U.K. U.N. E.U.".split()
COMPANIES = "Inc Corp Ltd Co Bros".split()
MEASURES = "approx dept".split()

# Nouns that continue a country's abbreviation.
INSTITUTIONS = """Senate Congress House Capitol Supreme Federal National State Department Administration Agency Bureau Commission Committee
Council Court Office Service Army Navy Marines Marine Air Coast Guard Military Forces Pentagon President Vice Secretary Attorney General
Ambassador Agriculture Commerce Labor Health Housing Transportation Energy Education Veterans Postal Census Treasury Interior Justice
Defense Homeland Security Border Customs Immigration Representatives White Parliament Commons Lords Crown Royal Prime Minister Cabinet
Monarchy Queen King Assembly Peacekeeping Charter Resolution Central Bank Government Embassy Consulate Constitution Citizen Citizens
Territory Dollar Dollars Economy Policy Law Code""".split()

# Names with an exclamation mark.
BRANDS = "Yahoo! E! Jeopardy! Bam! Go! Wham! Kaboom! Yum! FreshDirect! Boost!".split()

# Titles before a name.
TITLES = "Dr Mr Mrs Ms Prof Rev Gen Col Capt Lt Sgt Rep Sen Gov Pres Hon Adm Cmdr Maj Cpl Pvt Ens Brig Spec Pfc Fr Msgr Mme Mlle Messrs Amb Atty Dir Insp Asst Dep Commr Cllr Cong Br Esq Mgr Supt Del Min".split()
NAME_TITLES = "Dr Mr Mrs Ms Prof Sr Jr Rev Gen Col Capt Lt Sgt Rep Sen Gov Pres Hon Adm Cmdr Maj Cpl Pvt Ens Brig Spec Pfc".split()
SUFFIXES = "Sr Jr".split()

# Reference words that take a number.
NUMBERED = "no nos vol vols pt ch chs sec secs sect fig figs p pp art arts para paras pars app appx eq tab fn ann annot abr illus introd def ex pref lit n nn l ll bk bks ms mss fol fols cols frag rpt supp suppl corr ser ed eds trans comp comps repr rev".split()

# Places, dates and units.
PLACES = "Sq Ter Rte Twp Jct Ctr Isl Pen Riv Lk Mtn Apt Pkwy Hwy Bldg Ste Ln Ct Pl Rd Blvd Ave St Mt Ft".split()
DATES = "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mon Tue Tues Wed Thu Thur Thurs Fri Sat Sun".split()
FIRMS = "Assoc Grp Intl Mfg Dist Mgmt Ent Tech vs".split()
UNITS = "est min max avg std sq wt ht temp alt lat lon diam deg qty".split()

# Scholarly Latin and its kin.
LATIN = "viz op loc ca c fl sc scil sic id ead ap ff inf sup vid resp cap lib libb tit gl gloss schol cod codd serm hom lect quaest disp anon b d r".split()
GUARDED_LATIN = "cf ibid".split()
DOTTED = "N.B q.v s.v s.vv c.f a.k.a P.S P.P.S q.e.d r.i.p s.a s.l s.n v.i v.s e.a a.d a.c b.c a.u.c i.q i.c l.c l.s m.s n.d n.p n.s n.t p.c p.p t.b".split()
PHRASES = ["op. cit", "loc. cit", "art. cit", "ad loc", "ad fin", "ad init", "ad inf", "ad med", "ad litt", "ad rem", "in loc", "in re", "in ext", "in toto", "ut sup", "ut inf", "ut cit", "ut al", "et seq", "pro tem"]

# Sciences, grammar and editing.
SCIENCES = "diag symp anat biol chem phys psych surg ped pharm vet neuro cardio derm ortho path rad sp ssp var fam ord".split()
GRAMMAR = "adj adv prep conj pron pl sing colloq dial arch obs esp prob usu occas attrib compar superl refl subj imper".split()
EDITING = "auth bibl biog calc cat cent cit cl coll comm conc conf const cont crit deriv dict disc doc dram eccl encyc eval excl exec expl gram hist incl juris lang misc mod natl orig phil proc prov pub rec ref reg rel sched spec stat struct symb syn trad".split()

# Words after which a company's suffix is no end.
FUNCTION_WORDS = """a an the in on at by to of for as via re per with from into onto upon about above across after against along amid among
around before behind below beneath beside between beyond despite down during except inside near off outside over past since than throughout
toward through under until unto up within without not also even only just both either neither see note specifically particularly especially
including excluding containing covering""".split()
JOINING_WORDS = "and or but nor yet so".split()
WEEKDAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()

# Headings with a number.
HEADINGS = "Part Module Week Chapter Section Step Phase Unit Level Stage".split()
MONTHS = "January February March April May June July August September October November December".split()
BULLETS = "•⁃◦▪▸▹●○◆◇★☆✓✔✗✘➢➤›»"

# Reference stems before a number within a sentence.
STEMS = "p pp ch chs pt fn eq tab app appx art arts para paras pars par ann annot abr illus introd def ex pref lit n nn l ll bk bks ms mss fol fols col cols frag rpt suppl corr vol vols sec secs sect fig figs no nos ref vs ext ed eds trans comp comps repr rev ser ca fl cont".split()

# Misread words and what they stand for.
OCR = {"Iam": "I am", "iam": "I am", "Ihave": "I have", "ihave": "I have", "Ithink": "I think", "ithink": "I think", "anda": "and a", "witha": "with a", "sucha": "such a", "aliquid": "a liquid"}

# Quotation marks.
DOUBLE_QUOTES = "“”„‟«»″〝〞〟＂"
SINGLE_QUOTES = "‘’‚‛‹›′‵＇`´ʹʼˈ՚׳ߴߵ᾿᾽ꞌ"

# Words that an apostrophe at their start shortens.
ELISIONS = """tis twas twere twill twould taint tother sblood sdeath swounds sbodikins slid strewth zounds bout bove cross fore fraid gainst live loft
lone long mid midst mong mongst neath round sleep tween twixt wake ware way cause cuz coz hind low side yond cept scaped specially splain
spect e em er ere im is ave avin ead ear eard eart eaven eavens eavy eck edge eel eight ell elp en ero igh ill imself int it itch obby old
ole oliday oller ollow oly ome onest oney onor onour ood ook oop ope orizon orn orrible orse ospital ot otel our ouse ow owever uge undred
ungry unt urry urt usband alf all am and andsome appen appy ard arm at ate ese ey ose ough rough count fter gain gin less nother nough nuff
pears pon prentice scuse spite spose stead tarnal tend thout til till un kay sup dya ja yer copter cello member""".split()

# Letters (first and last of each run) of Unicode 14 and 15, which DuckDB knows and Java 17 does not.
NEW_LETTERS = """870-887 889-88E 8B5-8B5 8C8-8C9 C5D-C5D CDD-CDD 170D-170D 171F-171F 1B4C-1B4C 2C2F-2C2F 2C5F-2C5F 9FFD-9FFF A7C0-A7C1 A7D0-A7D1 A7D3-A7D3
A7D5-A7D9 A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 10780-10785 10787-107B0
107B2-107BA 10F70-10F81 11071-11072 11075-11075 1123F-11240 11740-11746 11AB0-11ABF 11F02-11F02 11F04-11F10 11F12-11F33 12F90-12FF0
1342F-1342F 13441-13446 16A70-16ABE 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132-1B132 1B155-1B155 1DF00-1DF1E 1DF25-1DF2A
1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 31350-323AF""".split()
LETTER = r"[\p{L}" + "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in (run.split("-") for run in NEW_LETTERS)) + "]"


def any_of(words: list[str]) -> str:
    """A pattern for one of the words, longer ones first."""
    return "(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=lambda w: (-len(w), w))) + ")"
