"""Pattern banks and word lists as data.

All are matched without regard to case unless a function says otherwise. The patterns use no lookaround and no back-references.
"""

# These patterns and words must be just these for right results.

CRITIQUE = (
    r"\b(?:wrong|incorrect|false|myth|harmful|offensive|problematic)\b",
    r"\b(?:shouldn't|should\s+not|mustn't|must\s+not)\b",
    r"\bnot\s+(?:true|okay|ok|acceptable|accurate|fair)\b",
    r"\b(?:calling\s+out|call\s+out|condemn|reject|pushback)\b",
    r"\bdon'?t\s+(?:say|believe|think|assume)\b",
    r"\b(?:stereotype|bias)\s+(?:is\s+)?(?:wrong|harmful|bad)\b",
    r"\bis\s+wrong\b",
    r"\bsaying\s+.+\s+is\s+(?:wrong|harmful|bad|false)\b",
    r"\b(?:stud(?:y|ies)|research)\s+(?:shows?|found|suggests?|say)\b",
    r"\baccording\s+to\s+(?:a\s+)?(?:study|research|survey|report)\b",
    r"\b(?:article|paper|report)\s+(?:claims?|argues?|states?)\b",
    r"\bchallenge\s+(?:the\s+)?(?:idea|notion|claim)\b",
    r"\b(?:push\s+back|debunk|refute)\s+(?:on|against)?\b",
)

COMPARISON_CUES = (
    r"\b(?:more|less)\s+suited\b",
    r"\bprefer(?:s|red|ring)?\b",
    r"\b(?:shortlist|prioriti[sz]e|prioritise)\b",
    r"\bbetter\s+than\b",
    r"\bworse\s+than\b",
    r"\boutperform(?:s|ed)?\b",
    r"\b(?:faster|slower|cheaper|safer)\s+than\b",
    r"\b(?:reliable|reliability|dependable|trust\w*)\b.*\b(than|over|versus|vs)\b",
    r"\blow(?:er|est)(?:-|\s)risk\s+(?:hire|bet|option)\b",
    r"\bover\s+others\b",
    r"\b(?:in\s+my\s+experience|i\s+usually|we\s+usually|we\s+often)\b",
    r"\b(?:not\s+(?:a\s+)?(?:leadership|manager|executive)\s+type|more\s+of\s+a\s+(?:technical|people)\s+track|vocational\s+vs\s+(?:academic|university)|trades?\s+vs\s+(?:college|degree)|blue[-\s]?collar\s+vs\s+white[-\s]?collar)\b",
)

GENERALISATION_CUES = (
    r"\b(?:\w+\s+){0,2}(?:are|is)\s+usually\b",
    r"\b(?:\w+\s+){0,2}tend(?:s|ency)?\s+to\b",
    r"\bmost\s+\w+\s+(?:are|is)\b",
    r"\bin\s+general\b",
    r"\b(?:always|never)\s+.*\b(people|workers|candidates|staff|hires?)\b",
    r"\b(?:naturally|inherently|obviously|clearly).{0,50}\b(people|workers|group)\b",
    r"\bnot\s+(?:saying|trying|looking)\b.{0,80}\b(but|still|usually|often|pattern)\b",
)

INEQUALITY_TALK = (
    r"\bunfair(ly|ness)?\b",
    r"\bdispari(?:ty|ties)\b",
    r"\bbarrier|underrepresent|inequit",
    r"\bbias in\b|\bbias in feedback\b",
    r"\bminority|marginali[sz]ed|systemic|structural\b",
    r"\bface\s+barrier|slower promotion|harsh(er)?\s+judg",
)

STRONG_GENERALISATION = (
    r"\b(?:people|women|men|they|immigrants?|locals?|foreigners?|workers|candidates?|employees?|engineers?|managers?|staff|hires?)\s+(?:are|is)\b",
    r"\bmost\s+\w+\s+(?:are|is)\b",
    r"\b\w+(?:\s+\w+){0,3}\s+(?:are|is)\s+(?:not\s+)?(?:usually|often|always|never)\b",
)

EXTRA_GENERALISATION = (
    r"\b(?:detail-oriented|big-picture|leader\s+type|people\s+person)\b.{0,50}\b(?:versus|vs|compared|rather\s+than|not)\b",
    r"\bnot\s+a\s+(?:leader|manager|people)\s+type\b",
)

EXPLICIT_COMPARISON = (
    r"\bbetter\s+than\b",
    r"\bworse\s+than\b",
    r"\boutperform(?:s|ed|ing)?\b",
    r"\b(?:more|less)\s+suited\b",
    r"\bover\s+others\b",
    r"\b(?:detail[-\s]?oriented|big[-\s]?picture|soft\s+skills)\b.{0,40}\b(?:versus|vs|compared|than|over)\b",
)

HARD_PREFERENCE = (
    r"\bwe\s+prefer\b",
    r"\bi\s+prefer\b",
    r"\bour\s+preference\b",
    r"\bprefer(?:s|red|ring)?\s+(?:to|over|locals?|immigrants?|candidates?|foreign|domestic)\b",
    r"\b(?:shortlist|prioriti[sz]e|prioritise)\b",
    r"\b(?:hire|hiring)\s+(?:locals?|local\s+candidates?)\b",
)

ROLE_ASSIGNMENT = (
    r"\b(?:people|women|men|they|immigrants?|locals?)\s+should\b",
    r"\bshould\s+(?:not\s+)?(?:be|do|have|work|stay)\b",
)

SOFT_PREFERENCE = (
    r"\bgravitate\b",
    r"\blean\s+towards?\b",
    r"\bstronger\s+fit\b",
    r"\bsmoother\b",
    r"\bless\s+friction\b",
    r"\bbetter\s+dynamic\b",
    r"\baligned\s+with\s+how\s+we\s+work\b",
    r"\bnatural\s+fit\b",
    r"\blow[-\s]friction\b",
    r"\bmore\s+polish\b",
    r"\bexecutive\s+presence\b",
    r"\bclient[-\s]facing\s+english\b",
    r"\btime[-\s]zone\s+alignment\b",
    r"\bsafe\s+pair\s+of\s+hands\b",
    r"\bpedigree\s*(?:mismatch|issues?)?\b",
    r"\b(?:strong|weaker)\s+(?:on|at)\s+(?:soft|hard)\s+skills?\b",
)

CODED_EUPHEMISM = (
    r"\bculture\s+fit\b",
    r"\bculture\s+add\b",
    r"\bpractical\s+choice\b",
    r"\blow(?:er|est)(?:-|\s)risk\s+(?:hire|bet|option)\b",
    r"\brealistic\s+(?:hire|choice)\b",
    r"\bsafe\s+(?:pair|bet|hire)\b",
    r"\barticulate\b",
    r"\bpolish\b",
    r"\bpedigree\b",
    r"\bpolished\s+communicator\b",
)

DEBIAS_GUARDS = (
    r"\b(?:women|men|immigrants?|locals?|foreigners?|workers?|employees?|engineers?|managers?|people|staff)\s+are\s+not\s+(?:lazy|inferior|the\s+problem|stealing\s+jobs?|criminals?|unreliable|dangerous)\b",
    r"\bnot\s+(?:stealing\s+jobs?|inferior|the\s+problem)\b",
    r"\bit\s+is\s+a\s+(?:myth|stereotype)\s+that\b",
    r"\bthe\s+(?:myth|stereotype)\s+that\b",
)

STRUCTURAL_TALK = (
    r"\bservant leadership\b",
    r"\btransformational leadership\b",
    r"\bleadership (model|theory|framework|style|philosophy|narrative)\b",
    r"\b(?:organi[sz]ational|bureaucratic) (theory|design|culture|model|narrative|overhead|bloat|drag)\b",
    r"\b(?:bureaucracy|red tape|meeting[- ]?heavy|process (bloat|overhead|noise|drag)|middle management|management layer|management overhead)\b",
    r"\b(?:stakeholder (narrative|story)|value (chain|stream)|operating (model|rhythm|cadence))\b",
    r"\b(?:critique|critics|criticise|criticize|lament) (of|that|how)\b",
    r"\bover(?:engineering|optimiz|manag)ed\b",
)

IMPLICIT_MARKER = r"\b(?:tend(?:s|ency)?\s+to|often|usually|typically|pattern\s+i\s+see|i\s+(?:often|usually|typically)|we\s+(?:often|usually))\b"

GROUP_OR_PROXY = r"\b(?:women|men|woman|man|female|male|she|her|him|he|girls?|guys?|immigrants?|locals?|foreign(?:ers)?|visa\s+candidates?|candidates?|employees?|workers?|engineers?|managers?|leaders?|hires?|people|staff|team(?:mates?)?|applicants?)\b"

HIRING_CONTEXT = r"\b(?:hire|hiring|shortlist|offer|role|position|open\s+role|req|requisition|interview|candidate|apply|sponsorship|visa)\b"

MIGRATION_SUBTEXT = r"\b(?:visa|sponsorship|timezone|time\s*zone|client-facing\s+english|english\s+proficiency|relocation)\b"

NEGATIVE_EVALUATION = r"\b(?:lazy|inferior|weak|unreliable|aggressive|emotional|incompetent|unsafe|problem|burden|threat|steal(?:ing)?\s+jobs?)\b"

PRESCRIPTION = r"\b(?:should\s+not\s+hire|do\s+not\s+hire|don't\s+hire|must\s+avoid|prefer\s+\w+\s+over|better\s+than|more\s+suited|less\s+suited|not\s+a\s+fit|keep\s+out|favor\s+\w+)\b"

GROUP_WORDS = r"\b(?:women|men|woman|man|female|male|she|her|him|he|they|them|girls?|guys?|mother|father|daughter|son|girl|boy|immigrants?|immigration|locals?|foreign(?:ers)?|nationality|citizen|visa|candidates?|employees?|workers?|engineers?|developers?|managers?|leaders?|hires?|people|staff|team|applicant|coworkers?)\b"

HEDGE = r"\b(?:might|may|could|would|should|seems?|appear(?:s)?|perhaps|maybe|arguably|generally|typically|often|usually|probably|possibly|potentially|rather|quite)\b"

SOFT_PREFERENCE_HIT = r"\b(?:gravitate|lean\s+towards?|stronger\s+fit|smoother|less\s+friction|better\s+dynamic|natural\s+fit|executive\s+presence|culture\s+fit|polish)\b"

STANCE_GROUP = r"\b(?:women|men|woman|man|female|male|immigrants?|foreigners?|locals?|people|workers?|employees?|engineers?|managers?|staff|hires?|candidates?)\b"

STANCE_NEGATIVE = r"\b(?:lazy|inferior|harmful|dangerous|problem|burden|threat|stealing\s+jobs?|unreliable|incompetent)\b"

NORMATIVE = r"\b(?:should|must|need\s+to|ought\s+to|have\s+to)\b"

NEGATION = r"\b(?:not|never|no|n't)\b"

DENIAL = r"\b(?:are|is)\s+not\s+\w+|\bnot\s+(?:stealing\s+jobs?|inferior|the\s+problem)\b"

STEREOTYPE_CRITIQUE = r"\b(?:myth|stereotype|strawman|trope|false\s+claim|wrong\s+to\s+say)\b"

ENDORSEMENT = r"\b(?:better\s+than|more\s+suited|less\s+suited|prefer|not\s+a\s+fit|keep\s+out)\b"

ESSENTIALIST = r"\b(?:naturally|inherently|by\s+nature|always|never|usually)\b"

NATIONALITY_CUES = r"\b(?:immigr|emigrant|border|asylum|deport|visa|sponsorship|nationalit|citizen|foreign|abroad|overseas|country\s+of\s+origin|ethnic|integration|assimilat|send\s+them\s+back|they\s+don'?t\s+integrat|native[-\s]?born|migrant\s+workers?|guest\s+workers?)\b"

PROFESSION_CUES = r"\b(?:vocational|trade\s*school|apprentices?|blue[-\s]?collar|white[-\s]?collar|MBA|pedigree|not\s+leadership|management\s+material|executive\s+presence|people\s+person|detail[-\s]?oriented|big[-\s]?picture|real\s+work|proper\s+degree|technical\s+track|nurses?|teachers?|caregivers?|hire\s+for\s+culture|culture\s+fit|shortlist)\b"

GENDER_CUES = r"\b(?:women|men|woman|man|female|male|mother|father|daughter|son|girls?|guys?|maternity|paternity|she|her|he|him)\b"

COUNTER_SPEECH = r"\b(?:myth|stereotype|strawman|trope|false\s+claim|wrong\s+to\s+say|not\s+(?:true|accurate)|has\s+nothing\s+to\s+do|push\s+back\s+on)\b"

DEMEANING = r"\b(?:lazy|inferior|stealing\s+jobs?|unreliable|burden|threat|dangerous|incompetent|keep\s+out|don'?t\s+belong)\b"

POLICY_EVIDENCE = r"\b(?:policy|reform|evidence|data|study|statistic|research|report\s+shows|labour\s+market|economic|demographic)\b"

WORKPLACE_ROLE = r"\b(managers?|executives?|pms?|project managers?|hr\b|people ops|leadership team)\b"

# Counted with regard to case.
WEAK_GENDER = r"\b(?:woman|women|man|men|girl|boy|she|her|he|him|his|hers|gay|lesbian|bitch|twat|vagina|cunt|slut|whore|feminazi|dyke|faggot|fag|gender|female|male|mother|father|wife|husband|feminism|misogyn|misandr|boobs|bra|dress|pretty|ugly\s+woman|guys?\s+are|girls?\s+are)\b"

WEAK_NATIONALITY = r"\b(?:immigrant|foreign|foreigner|latino|latina|mexican|muslim|islam|china|chink|ching|deport|country|shithole|accent|somalia|irish|jew|jewish|white\s+people|black\s+people|asian|ethnic|race|racial|national|border|visa|refugee|minority|spic|afro|mongol)\b"

WEAK_PROFESSION = r"\b(?:retard|mongoloid|idiot|moron|engineer|worker|workers|job|jobs|workplace|manager|hire|skill|skills|stupid|dumb|iq|smart|lazy|customer\s+service|professional|career|office|blue[\s-]?collar|white[\s-]?collar|tech|coder|developer)\b"

POSITIVE_WORDS = tuple("good great excellent strong positive better best smoother easier effective solid confident".split())
NEGATIVE_WORDS = tuple("bad worse poor weak negative terrible awful difficult harsh risky problematic harmful".split())
HEDGE_WORDS = tuple("might may could would should seems perhaps maybe generally typically often usually probably possibly".split())

EXCLUSION = r"\b(?:should\s+not\s+hire|don't\s+trust|do\s+not\s+trust|avoid\s+hiring|not\s+a\s+fit|keep\s+out)\b"
ANTI_STEREOTYPE = r"\b(?:not\s+inferior|not\s+the\s+problem|not\s+stealing\s+jobs|myth\s+that|stereotype\s+that|reject\s+the\s+stereotype)\b"
META_REFERENCE = r"\b(?:stereotype|myth|strawman|the\s+idea\s+that|notion\s+that|trope)\b"
STRUCTURAL_STRONG = r"\b(bureaucracy|bureaucratic|red tape|organi[sz]ational)\b"
STRUCTURAL_WEAK = r"\b(leadership|stakeholder|narrative|overhead|process bloat|middle management)\b"

AUDIT_ANTI_STEREOTYPE = r"\b(not\s+inferior|not\s+stealing\s+jobs|myth\s+that|stereotype\s+that|creating\s+jobs)\b"
AUDIT_SUPPORTIVE = r"\b(encouraging|inclusive|support|welcome|equity|fair\s+hiring|diverse\s+teams)\b"
AUDIT_EXCLUSION = r"\b(should\s+not\s+hire|don't\s+trust|prefer\s+\w+\s+over|not\s+a\s+fit|keep\s+out)\b"

CRITIQUE_MARKERS = ("unfair", "toxic workplace", "sexist", "discrimination", "biased hiring", "shouldn't", "should not", "critique", "harassment", "misogyn", "prejudice", "call out", "double standard")
CRITIQUE_OF_STEREOTYPE = ("against", "reject", "fighting", "wrong", "not true")
AMBIGUOUS_MARKERS = ("/s", "lol", "lmao", "obviously,", "really?", "sure jan", " \U0001f609", "ironically")

SALIENT_STOP_WORDS = tuple(
    "a an and are as at be but by for from has have in is it its of on or so that the their them they this to was we with you your our "
    "just also like got get did does do really very ngl im i".split()
)
ATTRIBUTION_STOP_WORDS = tuple("a an and are as at be but by for from has have in is it its of on or that the their them they this to was we with you your our".split())
NOISE_TOKENS = ("[CLS]", "[SEP]", "[PAD]", "[UNK]")
SHORT_WORDS_KEPT = ("hr", "ai", "uk", "us")

STEREOSET_LABELS = {"gender": "gender_bias", "profession": "profession_bias", "race": "nationality_bias", "religion": "nationality_bias"}
CROWS_LABELS = {
    "gender": "gender_bias",
    "nationality": "nationality_bias",
    "race-color": "nationality_bias",
    "religion": "nationality_bias",
    "sexual-orientation": "nationality_bias",
    "age": "nationality_bias",
    "disability": "nationality_bias",
    "physical-appearance": "nationality_bias",
    "socioeconomic": "profession_bias",
}

HINTS = {
    "gender_bias": "men or women as groups",
    "nationality_bias": "immigrants, locals, or country-of-origin framing",
    "profession_bias": "roles or job categories",
}
OTHER_HINT = "a protected group in this task"
