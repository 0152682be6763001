"""The small labelled table from which the personal-data model is trained.

Written from general knowledge of how letters and reports name people and tell how to reach or
identify them; no row of any input table was used.  Sentences are patterns with typed slots
and alternatives, fillers come from name lists of many countries, from invented syllables and from
random number forms.  Rendering a pattern gives text and the exact spans of its slots, in
ordinary, capital and small letters, sometimes misread.  The unknown words of sentences without
personal data come from syllables and from the whole words of a public tokenizer's vocabulary.
"""

from __future__ import annotations

import random
import re

SLOT = re.compile(r"<([NPEIATWwdnm])>")
CHOICE = re.compile(r"\{([^{}]*)\}")
WORD = re.compile(r"[^\W\d_]{4,}")
KIND = {"N": "name", "P": "phone", "E": "email", "I": "id_number", "A": "address"}

# Labelled patterns. N name, P phone, E e-mail, I number of a person, A address; T town, W and w unknown words,
# d a day, n a small number, m a number of any form that identifies nobody; {a|b} alternatives.
PATTERNS = """
{Patient|Patient name|Name|Name of patient|Full name|Surname|Client|Pt|Pt.|Pt name}{: | - |: | | = }<N>
{Patient|Patient name|Name|Pt|Client}{: | - | | }<N>{, |; | / | | (}{aged <n>|<n> years old|<n> yrs|<n>y|male|female|M/<n>|F/<n>|DOB <d>}
{Patient|Pt|Client} <N> {was seen|came back|attended|was brought in|is known to us|walked in|presented|returned|was reviewed} {today|on the ward|in clinic|with cough|on <d>|yesterday|for review}{.|}
{Mr|Mrs|Ms|Miss|Mr.|Mrs.|Alhaji|Chief|Madam|Mme|M.|Pastor|Engr.|Baby of Mrs} <N> {was seen|attended|came|has been told|is known|can be reached|complains of cough|asked for a copy|was informed}{ today|.| on <d>|}
{Thank you for seeing|Many thanks for referring|Kindly see|Please see|Please review|Kindly review|I reviewed|We saw|Letter about|Regarding|Re:|RE:} {Mr|Mrs|Ms|Miss|this patient,||} <N>{.|, aged <n>.| who has a cough.|}
{Mother|Father|Brother|Sister|Wife|Husband|Son|Daughter|Uncle|Aunt|Guardian|Carer|Spouse|Next of kin|NOK|Relative|Friend|Neighbour}{: | | - |, | (}<N>{.||,|)|; informed.| informed.}
{Accompanied|Brought|Escorted|Carried in|Collected|Taken home|Held|Interpreted} by {his|her|the|their|} {mother|father|brother|sister|wife|husband|son|daughter|uncle|aunt|guardian|niece|nephew|cousin|grandmother|friend|neighbour|carer}{ | |, }<N>{.|| who waits outside.| and left.}
{Here|Came|Arrived|In|Attended|Lives|Stays} with {his|her|the} {mother|father|brother|sister|wife|husband|son|daughter|aunt|cousin|nephew|niece|grandson}{ |, | }<N>{.||, who interpreted.}
{His|Her|The|Patient's} {mother|father|brother|sister|wife|husband|son|daughter|aunt|carer|guardian|niece}{ |, | }<N>{, | }{gave consent|signed the form|was told|says he is better|reports night sweats|agreed|was present|phoned}{.|}
{Report discussed with|Discussed with|Findings given to|Result given to|Told|Informed|Handed to|Shown to|Spoke to|Spoke with|Called|Rang|Result handed to|Notified} {Dr|Dr.|Prof|Prof.|Sister|Nurse|Mr|Mrs|Matron|} <N>{.|| at <n>:30.| of the {heart|eye|skin|day} clinic.| on the ward.| by telephone.}
{Reported by|Read by|Dictated by|Verified by|Checked by|Typed by|Transcribed by|Entered by|Approved by|Authorised by|Second reader|Reader|Reviewed by|Prepared by|Films read by|Report by}{: | | }{Dr |Dr. |Prof. |||}<N>{.||, MD|, FRCR|, consultant|, registrar| (registrar)| / consultant|, radiologist| on <d>|, <d>}
{Requested by|Referred by|Referring doctor|Referrer|Ordered by|Sent by|Booked by|Requesting clinician|Referral from|GP|Clinician|Consultant|Attending|Physician|Doctor}{: | | }{Dr |Dr. |Prof |||}<N>{.||,| ({medical|surgical|chest} unit)}
{Signed|Signed by|Sgd|Sign|e-signed|Electronically signed by|Signature|Countersigned by}{: | | - |: }{Dr |Dr. |||}<N>{.||, <d>}
{Dr|Dr.|Prof|Prof.|Doctor} <N>{.||, radiologist| / radiologist|, consultant physician| (chest)|, FMCR| (locum)|, senior registrar}
<N>{, MD|, MBBS|, FRCR| (radiologist)| / radiologist|, consultant|, radiographer|, records clerk| (clerk)|, registrar|, house officer| - radiologist|, PhD}{.|}
{Radiographer|Clerk|Nurse|Matron|Sister|Porter|Typist|Records clerk|Receptionist|Technician|Interpreter|Registrar|House officer|Midwife|Pharmacist|Secretary}{: | | | - }<N>{.|| on duty.| took the film.| was present.}
{Films|Images|Results|Report|Copy} {collected|taken|picked up|received|requested|seen|fetched} by {Mr |Mrs |Dr |||}<N>{.|| on <d>.| at the desk.}
{Yours sincerely|Kind regards|Regards|Best wishes|Thanks|Sincerely}{,|}{ | }{Dr |Dr. ||}<N>
{cc|CC|Copy to|Copies|Cc}: {Dr |Dr. |Prof. |Mr ||}<N>{.||; file|, <A>| <<E>>| (<E>)}
{Dear} {Dr|Dr.|Prof.|Mr|Mrs|Ms|Sister} <N>{,||:}
{Ask for|Attn|Attention|Contact|Contact person|For the attention of|Speak to|Call}{: | | }{Dr |Mr |Mrs ||}<N>{.|| on <P>.|, <P>| at <E>| (<P>)|, extension <n>.}
{Dr|Dr.|Prof.} <N> {thinks|agrees|advised|suggests|asked|wants|will review|has seen|noted|requested}{ a repeat film| this film| that no change is seen| a lateral view| follow-up| the old films}{.|}
{Dr|Dr.|Drs} <N> and {Dr |Dr. |}<N>{.|| agree.| read both films.}
{Known to|Patient of|Under|Under the care of|Admitted under|Follow-up with|Appointment with|To see|Operated by|Reviewed with} {Dr|Dr.|Prof|Prof.|Mr} <N>{.|| since <d>.| for years.}
{Father of|Mother of|Twin of|Not to be mixed up with|Same name as|Previously registered as|Also known as|Formerly} <N>{.||, other file.}
{Consent given by|Witness|Witnessed by|History from|History given by|Information from|Told by|Consented by}{: | }{Mr |Mrs |his son |her sister ||}<N>{.|}
<N>{, | }{<n>-year-old|<n> year old|<n>y|aged <n>|<n> yrs} {man|woman|male|female|teacher|farmer|trader|boy|girl}{, cough.|.| with fever.|}
<N>, {ID|MRN|hospital no.|card|file no.|NIN} <I>{.||, <P>}
{Tel|Tel.|Tel no.|Telephone|Phone|Phone no.|Mobile|Mob|Cell|Fax|GSM|Call|Ring|WhatsApp|Contact|Hotline|Contact number|Phone number|Home tel|ph}{: |: | | |. | = |=}<P>{.||;|,| after 5 pm.| (home)}
{Please|Kindly|You may|We can} {call|ring|phone|text|dial|reach us on|contact} <P>{ | |. }{with the result|before noon|if worse|for the next date|when ready|.|}
{Result|Report|Findings} {phoned|telephoned|rung|called|texted|read out|sent by SMS} {through |||}to {Dr |Mrs |||}<N>{ on | at | (|, }<P>{.||).}
{Reachable|Can be reached|Might be reached|Available|Contact the family|Reach him|Reach her|Family can be reached} {on|at|by phone on|under} <P>{.|| or <P>.| or at <E>.| or <E>}
{Next of kin|NOK|Kin|Emergency contact|Guardian|Carer}{: | | - |, }<N>{, |; | / | (| - }<P>{.||)|, <A>|; <A>}
{Next of kin|NOK|Emergency contact|Relative}{: | | }<N>{, |; | of }<A>{, <P>|; <P>|.|| tel <P>}
{His|Her|Patient's|The son's|The clinic's|New|Old|Wife's} {phone|number|mobile|line|telephone|cell} is {now |}<P>{.|}
{Email|E-mail|e-mail|Mail|E mail|email address|mailto|Electronic mail}{: | | = |:|=}<E>{.||;|,}
{Send|Forward|Mail|Email|Please send|Kindly send|Please email|Return} {it|the report|results|a copy|the film|images|the pictures} {to|at} <E>{.|| please.| today.}
{Write to|Contact|Reply to|Copy to|Questions to|Results to|Copies go to|Address queries to|Report to} {Dr <N>, |<N> at |||}<E>{.||, or call <P>.| or <P>}
<N> <<E>>{.||;|,}
{The patient|She|He|The mother|The clinic|Dr <N>|Mrs <N>} {uses|left|gave|can be written to at|prefers|wrote from} <E>{.|| as address.| for the result.}
{Hospital|hospital|Hosp.|Clinic|Patient|Pt|Medical record|medical record|Record|Case note|Folder|Chart|Health record|Registration|Outpatient}{ no. | no | number | No. | no: | no.: | nr. | #| ID | ID: | number: }<I>{.||,|;|.}
{MRN|M.R.N.|MRN|UHID|PID|Hospital ID|Unit number|EHR number|Hosp no|Hosp. no.}{: | | |. |=| - | no. | no. }<I>{.||,|;|.}
{NIN|National ID|national ID|ID|ID card|Identity card|identity|National identity|Social security|Citizen|Voter|Tax|BVN|Driving licence|Residence permit}{ no. | no | number | No. |: | | no: | no.: | card | card no. }<I>{.||,| shown.| seen at the desk.|.}
{Passport|passport|Travel document|Travel pass}{ no. | no | number | No. |: | | no: | | no. }<I>{.||, seen.| checked.| presented at reception.| expires <d>.|.}
{Insurance|insurance|Insurer|Policy|Member|Membership|HMO|Health insurance|Health card|Scheme|Enrollee|Beneficiary|NHIS|Health plan|Insured under|Card|card|Clinic card|Hospital card}{ no. | no | number | No. |: | | no: | no.: | no. }<I>{.||,| valid.| shown.| shown at the window.|.}
{Wristband|wristband|Wrist band|Bracelet|ID band|Arm band|Band|Identity band|Name band}{ no. | no | number | No. |: | | reads | says | no: | no. }<I>{.||,| checked.| matches.|.}
{Checked|Identified|Admitted|Verified|Confirmed|Scanned|Compared}{ by | with | against | using | on }{hospital|passport|insurance|wristband|ID|NIN|medical record|card|identity card}{ no. | no | number | }<I>{.|| by the desk.|, correct.}
{Patient|Pt|Client|Man|Woman|Child} {with|holding|carrying|under|showing} {hospital|passport|insurance|wristband|ID|NIN|medical record|card} {no. |number |no |}<I>{.|| was x-rayed.|, <n> years.}
{His|Her|Patient's|The patient's} {card|passport|file|insurance|hospital|record|NIN|identity|wristband|ID} {number is|no. is|reads|is|has the number} <I>{.|}
{Identified by|Identity checked with|Checked against|Registered under|Registered as|Filed under|Known under|Booked with} {card|passport|wristband|MRN|hospital number|NIN|file|ID|insurance card} <I>{.||,}
{Address|Home address|Addr|Add.|Residence|Home|Residing at|Postal address|Lives at|Resides at|Stays at|Living at|Residential address|Contact address}{: | | |: }<A>{.||,|;| with her son.| since <d>.}
{He|She|The patient|The family|Patient|The couple|The widow} {lives|stays|resides|lodges|is staying|has settled|has moved} {at|to} <A>{.||, near the market.| with <N>.| with his sister <N>.}
{Send|Post|Mail|Deliver|Courier|Return|Forward|Please post} {the report|the picture|previous films|results|a copy|the CD|it|old films} to <A>{.|| please.}
{<N>|Patient|Pt|The boy|The girl|Client|The woman|The man|A widow|Farmer|Trader|Teacher}{ of | from | at |, of |, | - }<A>{.||, <n> years.|, <P>|; <P>| with <w>.|, <w> <w>.}
{To|At|From|Post to|Sent to|Deliver to|c/o|Via|Return to|Home:|Now at|Formerly at|Moved to|Lives|Lodges|Lived at|living at|Collected at|Parcel for} <A>{.||;|, please.| <w> <w>.| on <d>.}
{Visited at|Found at|Collected from|Home visit at|Sent home to|Discharged to|Come from|Travelled from|Brought from|Ambulance from|Picked up from} <A>{.|| on <d>.}
<N>{, | of |; | - }<A>{.||, <P>|; tel. <P>}
{Patient|Name|Pt|Client}{: | | }<N>{, | of | - |; }<A>{.||, <P>|}
{GP|Family doctor|Clinic|Practice}{: | }Dr <N>, <A>{.||, <P>}
{Letter to|Letters to|Envelope|Deliver to}{: | }<N>, <A>{.|}
<P> {or|and|/} <P>{.|}
{Insurance|Card|NIN|MRN|Passport|ID} {no. |number |}<I>{, |; |. }{tel|phone|contact|mobile|email|e-mail}{: | |. }{<P>|<E>}{.|}
{Spoke|Talked} to {his|her} {wife|husband|mother|son} <N> {on|at} <P>{.| about the result.|}
{<W>|<W> <w>|Film <w>|It was <w>|Was <w>|Has been <w>|Copy <w>|Form <w>} {by|to|with|for|from|by the clerk|with the clerk|to the nurse|by nurse|with one|through|per|c/o|on behalf of} {Dr |Mr |Mrs |Nurse |||}<N>{.||,| on <d>.| at the desk.| and <w>.| <w> <w>.}
{Rev.|Sr.|Sister|Nurse|Matron|Hon.|Imam|Malam|Alhaja|Barr.|Capt.|Elder|Sir|Lady|Master|Miss|Ms.|Mrs.|Mr.|Dr.|Dr|Prof|Mr|Mrs|Madame|Monsieur|Sra.|Herr} <N> {<w>|<w> <w>|was <w>|is <w>|has <w>|will <w>|<w> the <w>|came <w>|did not <w>}{.||, <w>.| on <d>.}
{The|Our|A|His|Her|Their|This|One} {<w>|<w> <w>|patient|clerk|nurse|sister|brother|mother|father|wife|husband|son|daughter|aunt|uncle|doctor|reader|driver|teacher|neighbour|cousin|registrar|radiographer|typist|caller}{ | |, |: | is | called | named }<N>{ <w>| was <w>|,| signed| has <w>|.| phoned| waits}{.||}
{Seen by|Examined by|Reviewed by|Clerked by|Admitted by|Assessed by} {Dr |Dr. |Nurse |Prof. |}<N>{.|| in {casualty|outpatients|the clinic}.| on <d>.}
{Report for|Film of|X-ray of|Chest film of|Radiograph of|Study of|Previous film of|Referral for|Request for} {Mr |Mrs |Miss ||}<N>{.||, <d>|, {M|F}, <n> years}
""".strip().splitlines()

# Sentences without personal data, many close in wording to those with it.
PLAIN = """
{Reported|Typed|Read|Checked|Dictated|Signed off|Seen|Booked|Referred|Requested|Sent} by {the|a|our} {duty|night|senior|second|covering|on-call|visiting|junior} {doctor|radiologist|registrar|typist|reader|desk|team|clinic|consultant|radiographer|clerk}{.|| on <d>.| at <n>:20.}
{Reported|Typed|Signed|Dictated|Verified|Transmitted} {electronically|remotely|without comparison|awaiting signature|pending|by voice software|on the night shift}{.|}
{Consultant Radiologist|Senior Registrar|Radiographer|Clerk|Typist|Reader|Consultant|Signature|Signed|Name|Address|Phone|Email|Next of kin|Radiology Department|Duty doctor}{:| not given.| withheld.|.|: none.|: as above.| - see form.||: not stated.}
{Patient|The patient|Pt} {rotated|supine|unable to stand|moved during exposure|is well|remains stable|did not attend|was sitting|could not hold still|was discharged|is afebrile|consented|coughs at night}{.|}
{Name|Identity|Label|Side marker|Card|Address|Phone number|Wristband} {checked|confirmed|illegible|missing|not on film|matches the request|unreadable|removed}{.|}
{Discussed|Presented|Reviewed|Shown} {at the|in the|with the|during the} {morning meeting|chest meeting|referring team|ward round|multidisciplinary meeting|surgical team|nursing staff|family|relatives}{.|| on <d>.}
{Call|Phone|Ring|Contact|Inform|Page} {the ward|the desk|the clinic|reception|the team|the on-call doctor|the family} {if worse|with the result|before discharge|in the morning|when ready|today}{.|}
{Lives|Works|Stays|Resides} {near the|in a|at the|far from the|above the} {market|quarry|village|mill|shop|river|hostel|farm|school|harbour}{.|| with relatives.| with her children.| and smokes.}
{He|She|The patient|They} {lives alone|lives with relatives|works as a {tailor|welder|miner|teacher|trader|driver|farmer|mason|cook|nurse}|is a retired {clerk|soldier|miner|driver|teacher}|keeps birds|stopped smoking|was a smoker}{.|}
{Send|Bring|Post|Keep|Compare with} {the|all|any|previous|older} {films|images|reports|CD|results} {to the next visit|for comparison|with the patient|if available|to the archive|again}{.|}
{Send|Refer|Transfer|Return} to the {chest clinic|medical ward|outpatient department|archive|cardiology unit|emergency unit|screening unit|dispensary}{.|| in <n> weeks.}
{Referred|Sent|Transferred|Came|Brought in} from {the |}{chest clinic|medical ward|casualty|clinic|theatre|labour ward|health centre|general hospital|mission hospital|mobile unit|dialysis unit|prison clinic}, <T>{.|, <n> year old {man|woman|teacher|farmer|cook|driver} with {cough|fever|chest pain|weight loss|breathlessness}.|, <n>y, {cough|fever|wheeze}.|}
{Seen|Booked|Taken|Registered|Waiting|Film taken|Examined} {in|at} {the |}{chest clinic|medical ward|casualty|mobile unit|screening van|outpatients|records office|annexe|general hospital}, <T>{.|; {queue|ticket|bed|order|tray} {no. |number |}<m>.|, room <m>.|, {batch|ticket|order} <m>|}
{The|} <T> {hospital|clinic|health centre|general hospital|archive|ward|mission|district|branch|office|team|laboratory|screening programme}{ has| holds| sent| keeps} {the old films|no record|films <m> to <m>|earlier studies|a copy}{.|}
{From|To|At|In|Near|Via|Screening in|Outreach to|Clinic at} <T>{.|, <d>.| on <d>.|}
{Accession|Accession no.|Accession number|Acc|Acc.|Acc. no.|Acc no|Access. no.}{: | | }<m>{.||,|; {fair|good|poor|adequate} quality.}
{Film|Plate|Cassette|Image|Exposure|Series|Study|Slide|Disc|Sheet|Frame|Negative}{ | | no. | no | number | ID | serial | serial no. }{: |}<m>{.||,| of <m>.| re-scanned.| repeated.| is dark.}
{Order|Request|Request form|Batch|Lot|Ticket|Queue|Receipt|Invoice|Consignment|Job|Order ref.|Work list|Slot|Tray|Bed|Room|Shelf|Box|Drawer|Bay}{ | no. | number | no | }<m>{.||,| closed.| cancelled.|, room <m>.|, {shelf|row|bay} <m>.| on <d>.}
{Device|Serial|Device serial|Serial no.|Detector|Detector serial|Tube|Scanner|Machine|Monitor|Generator|Console|Software|Firmware|Processor|Pump|Pacemaker|Pacemaker serial|Stent|Valve|Probe|Unit}{ | no. | number | ID | model | version }<m>{.||,| checked.| calibrated on <d>.| replaced.| last checked at <m>:15}
{<w>|<W>|see|in|on|of|to|with|per|from|as on|similar to|compared with|same as|under|via|for|and} {accession|acc.|film|plate|cassette|study|order|request|batch|lot|ticket|queue|device|serial|series|image|sheet|slide|tray|archive|receipt|protocol|detector|sample|specimen|disc} {no. |no |number |no: |serial |ID |}<m>{.|,|;||, {fair|good|limited|full} quality.| <w> <w>.| on <d>.}
{Accession|Acc.|Acc|accession no.|Film|Film no.|film|Study|Study no.|study no.|Plate|plate|Plate serial|Order|Batch|batch|Device serial|Device|Device no.|Serial|serial no.|Queue|Ticket|Lot|Request|Image|Series|Cassette} <m>{.|,||; <w>.| <w>| <w> on <d>| checked at <n>:20.| <w> <w>, room <n>.|. <W> <w>.}
<w> <w>; {queue|order|batch|film|plate|study|ticket|accession|tray|device|serial|request|sample} {no. |number |no |}<m>{.||,}
{Contrast|Vaccine|Tracer|Reagent|Drug|Antibiotic|Gel} {batch|lot|lot no.|batch no.|vial} <m>{.||, expires <d>.}
{Protocol|Guideline|Form|Version|Code|ICD|Item|Page|Section|Table|Figure|Step|Line|Sequence|Cost centre|Department code}{ | no. | }<n>{.||,}
{Comparison|Compared|Compare|Old film|Prior|Previous study|Earlier film}{: | with | of |, }{film |study |}{no. |of |}{<m>|<d>|none|<d>, <m>}{.|}
{Exposure|Technique|Settings|Factors}: {<m> kVp|<m> kV|<m>.2 mAs|<m> mAs, <m> kVp|AP supine|PA erect|lateral decubitus}{.|, {good|poor|shallow|full} inspiration.|, film <m>.}
{The|A|No} <W>{'s|-<W>|} {sign|line|lines|focus|complex|hump|angle|index|score|node|tumour|disease|syndrome|classification|ratio|view|method|criteria|grade|stage|space|ring|tube|drain|catheter|needle|hernia|fracture|lesion|staging|manoeuvre} {is|of <n> mm is|measures <n> mm, is} {absent|present|seen|negative|not seen|noted|unchanged|positive|visible on the {left|right}}{.|}
{Kerley B|Kerley|Cobb|Ghon|Assmann|Pancoast|Westermark|Hampton|Fleischner|Golden|Kohn|Haller|Bochdalek|Morgagni|Swan-Ganz|Hickman|Foley|Ryle|Rasmussen|Hodgkin|Kaposi|Wegener|Caplan|Heimlich|Simon|Ranke|Luftsichel|Chilaiditi|Down|Marfan|Parkinson|Addison|Hounsfield|Trendelenburg|Lordotic|Doppler} {lines|line|angle|focus|tumour|sign|hump|lobe|syndrome|hernia|catheter|tube|disease|index|units|nodule|complex|aneurysm|position} {seen|absent|of <n> mm|at <n> degrees|in place|not identified|suspected|unchanged|excluded}{.|}
{CHEST RADIOGRAPH|CHEST X-RAY|CXR|CHEST FILM|RADIOGRAPH OF THE CHEST|Chest radiograph|Chest X-ray|X-ray chest|Radiology}{ REPORT| report||: PA view|, PA and lateral| (FINAL)| (ADDENDUM)| - REPEAT}{.|:|}
{Findings|FINDINGS|Impression|IMPRESSION|Conclusion|CONCLUSION|Comment|Comments|Summary|Opinion|Clinical details|Clinical information|Indication|History|Technique|Comparison|Body|Notes|Recommendation|Addendum|Diagnosis}{:| -|.|}
{Impression|Conclusion|Summary|Opinion}: {normal study|no acute disease|no active chest lesion|features of {heart failure|pneumonia|tuberculosis|pleural effusion}|unremarkable film|stable appearances|as above|within normal limits}{.|}
{Indication|Clinical details|History|Clinical information|Reason}{: | - | }{cough|fever|chest pain|breathlessness|weight loss|night sweats|haemoptysis|pre-employment|medical fitness|follow-up|trauma|wheeze|visa|hypertension|chronic cough|fall|leg swelling}{, |; | and | / }{<n> weeks|smoker|<n> year old {man|woman}|known hypertensive|since <d>|contact with TB|<n>y {M|F}|no fever|for fitness}{.|}
{A|This} <n>{-year-old| year old| y/o|-yr-old} {man|woman|boy|girl|male|female|farmer|trader|teacher|driver|welder|nurse|student|tailor|soldier|cook} {with|presenting with|who has|for} {cough|fever|dyspnoea|pain|weight loss|screening|check-up|palpitations|hoarseness} {for <n> days|since <d>|for <n> weeks|of <n> months}{.|}
{The|Both|No} {lungs|lung fields|hila|pleural spaces|costophrenic angles|diaphragms|airways|apices|bases} {are|appear|look|remain} {clear|well aerated|normal|unremarkable|hyperinflated|symmetrical|sharp|preserved|free of disease|slightly congested}{.|, <W> excluded.| on both sides.|}
{The|} {heart|cardiac shadow|cardiac silhouette|aorta|mediastinum|trachea|left atrium|cardiac apex|aortic arch|right heart border} {is|appears|remains|looks} {normal in size|enlarged|central|unfolded|prominent|displaced to the {left|right}|of normal size and shape|widened|calcified|borderline}{.|, CTR 0.<n>.| (ratio 0.<n>).| by <n> mm.|, cardiothoracic ratio = 0.<n>.}
{There is|There are|Note is made of|Shows|Demonstrates|I see|We see|Presence of} {a|an|some|no|several|multiple|<n>} {small|large|ill-defined|well-defined|round|oval|linear|patchy|dense|subtle|faint|irregular|calcified|cavitating|spiculate|<w>} {opacity|opacities|nodule|nodules|mass|shadow|lesion|consolidation|infiltrate|effusion|haziness|band|cyst|bulla|calcification|density|<w>} {in|at|over|near} the {right|left} {upper|middle|lower|mid|<w>} {zone|lobe|base|apex|hilum|lung|field}{.|, <n> mm.| measuring <n> x <n> mm.|, <n> cm across.| since <d>.}
{No|Without} {pleural effusion|pneumothorax|consolidation|focal lesion|cavity|mass|adenopathy|bony lesion|rib fracture|acute change|collapse|free air|<w> change|<w> {shadow|nodule|opacity}} {is seen|seen|identified|detected|demonstrated|evident|today|on this view|noted}{.|}
{Size|Diameter|Depth|Width|Length|Height|Distance|Angle|Ratio|Volume|Weight|Temperature|Pulse|BP|SpO2|ESR|CTR|Hb|CRP}{: | | = |=| of }{<n> mm|<n> cm|<n>.4 cm|<n> x <n> mm|<n>/<n>|<n> degrees|<n>%|<n> ml|<n> bpm|0.<n>|<n>.5 kg|<n>}{.|,|}
{The|A|An} <w> <w> {is|was|remains|appears} <w>{ and <w>|}{ in the <w> zone| of <n> mm| on the {left|right}| since <d>|}{.|}
{Possible|Probable|Likely|Suspected|Mild|Moderate|Marked|Minimal|Bilateral|Unilateral|Resolving|Old|New} {<w>|basal|apical|perihilar|hilar|pleural|reticular|interstitial|nodular|alveolar|bronchial} {thickening|change|changes|scarring|fibrosis|shadowing|congestion|collapse|oedema|disease|markings|fluid|infection}{.|, {left|right} more than {left|right}.| since <d>.|, <n> mm.}
{Degenerative|Age-related|Healed|Old|Mild|Marked|No} {changes|fracture|scoliosis|kyphosis|osteophytes|spondylosis|callus|wedging} {of|in} the {spine|clavicle|ribs|shoulder|thoracic spine|sternum}{.|, T<n>.| at T<n>.|}
{Endotracheal|Nasogastric|Chest|Feeding|Tracheostomy|Central venous|Pleural|Gastric} {tube|line|drain|catheter|port} {in|is in|tip in|with its tip at} {good position|the {left|right} main bronchus|T<n>|the stomach|place|situ|the right atrium}{.|, <n> cm above the carina.|}
{Dual|Single} {lead|chamber} pacemaker {in place|over the left chest|with leads in good position}{.|, model <n>.}
{Repeat|Follow-up|Control|Lateral} {film|radiograph|view|CT|imaging|study} {in <n> weeks|advised|suggested|if symptoms persist|is recommended|after treatment|on <d>|may help}{.|}
{CT|MRI|Ultrasound|Echocardiography|Sputum test|Bronchoscopy|Biopsy|Mantoux test|GeneXpert|Spirometry} {is advised|suggested|could be useful|would help|recommended|to follow|on <d>|was negative|pending}{.|}
{Correlate|Compare|Please correlate|Clinical correlation|Kindly correlate} {clinically|with symptoms|with old films|with laboratory results|is advised|with sputum}{.|}
{Dated|Date|Taken on|Examined on|Report date|Done|Exam date|DOB|Date of birth|Admitted|Seen on|Printed|Time|Received}{: | | }<d>{.||,| at <n>:45.|, <n>:10}
{Age|Sex|Gender|Ward|Unit|Clinic|Room|Bed|View|Side|Priority|Status|Occupation|Department}{: | - | }{<n>|male|female|F|M|<n> years|surgical|medical|PA|erect|routine|urgent|outpatient|trader|paediatric}{.||,}
{Sheet|Note|Marker|Label|Plate|Sticker} {reads|says|shows|marked} "{<W>|<w> <w>|<W> <n>|<n>}"{.|, as {seen|noted} before.}
"{<w> <w>|<w>|<w>, <w>, since <d>}" {say the family|in the patient's own words|per the ward note|as the nurse wrote|according to the referrer}{.|}
{Ward|Nurse|Family|Relatives|Patient} {says|say|reports|reported|states|notes} {fever for <n> days|no pain|cough since <d>|<w> <w>|that all is well|"<w> <w>"}{.|}
{Thorax de face|Radiographie du thorax|Cliché|Cœur|Poumons|Silhouette cardiaque|Médiastin|Coupoles} {sans anomalie|normal|normaux|de taille normale|à contrôler|du <n> février|stable|augmentée de volume|bien dégagées}{.|, opacité à droite.| chez un homme de <n> ans.|, fièvre depuis <n> jours.}
{Opacité|Épanchement|Syndrome|Lésion|Surcharge|Image} {alvéolaire|pleural|interstitiel|hilaire|basale|nodulaire|rétractile} {gauche|droit|droite|bilatéral|récent|ancienne|du lobe supérieur}{.|, avis demandé.|, taille <n> mm.|, à revoir dans <n> mois.}
{Àyà|Ẹ̀dọ̀fóró|Ọkàn|Ikọ́|Ara|Egungun ìhà} {náà mọ́|wú díẹ̀|ń dùn mí|kò dá|tóbi jù|ti sàn|kò yí padà|dára} {.|láti ọjọ́ <n>.|fún oṣù <n>.|lónìí.}
{Di|Dis|Him|Her} {chest|heart|lung|cough|film|body} {dey clear|dey pain am|don big small|no get wahala|still dey|don better|no change}{.|, e don tey.| since <n> days.| for night.}
{Coração|Pulmões|Tórax|Derrame|Sem} {de tamanho normal|sem alterações|livres|pleural à esquerda|lesões agudas|pequeno|com opacidade à direita}{.|, febre há <n> dias.}
{Сердце|Лёгкие|Тень|Грудь|Перелом} {в норме|чистые|не расширена|без изменений|слева}{.|, <n> мм.}
{Καρδιά|Πνεύμονες|Θώρακας|Σκιά} {φυσιολογική|καθαροί|χωρίς βλάβη|αριστερά}{.|, <n> mm.}
{Old|Faded|Torn|Printed} label: {ÉTÉ <m>|À GAUCHE|NÃO DOBRAR|CÔTÉ DROIT|FRÄGIL|HAUT <m>}{.|; film <m>.}
{Grade|Stage|Type|Class|Category|Level|Score|T|L|C|Rib|Zone|Segment} {<n>|II|IIIa|B|<n>a|S<n>|T<n>}{.|,| on the {left|right}.| of <n>.}
{Tube|Line|Clip|Wire|Suture|Drain|Lead|Screw|Prosthesis} {seen|noted|present|unchanged|removed|in situ} {over the {left|right} chest|near the hilum|at T<n>|since <d>|in the midline}{.|}
{at|around|about|by|before|after} <n>:{15|30|40|05}{ on <d>| h| hrs|.|}
{Emergency|Screening|Follow-up|Routine|Private|Portable|Mobile|Bedside} {visit|film|study|examination|x-ray|view}{, <W> wing|, <W> ward|, <W> block|, level <n>|, room <n>|}{.|}
{<W>|<W> <W>} {Ward|Wing|Unit|Block|Clinic|Hospital|Centre|Hall|House|Annexe|Department|Theatre|Suite}{.|, room <n>.|, level <n>|, bed <n>.| on <d>.|: full.}
{Batch|Desk|Shelf|Courier|Sample|Parcel|Tray} <m> @ {<W> desk|the <T> office|<T>|the lab|counter <m>|reception}{.|, <m>.| on <d>.}
{Mail|Letters|Calls|Messages|Visitors} {go to the desk|to reception|are not forwarded|at the front office|after <n>:00}{.|}
{<n>|<n>,<n>|<n>/<n>|<n> - <n>|<n> x <n> x <n>} {films|plates|views|exposures|images|beds|cases|copies|pages|mm|cm|days}{.|, all seen.|}
{Street|Road|Market|Factory|Building|Home|Traffic|Plot} {dust|accident|exposure|work|trader|fumes} {for <n> years|on <d>|reported|noted}{.|}
{Fall|Accident|Injury|Fight|Crash} {on|at|near|along} {the road|the main road|<T> road|a building site|the {mill|market|bridge}}{.|, <d>.| <n> days ago.}
""".strip().splitlines()

# Given names and family names in common use in many countries.
GIVEN = """
Adaeze Aisha Amina Anita Anthony Babatunde Bilal Blessing Carlos Chiamaka Chidi Chinedu Claire Daniel David Deborah Emeka Emmanuel Esther Fatima
Folake Francis Funke George Grace Hannah Hassan Helen Ibrahim Ifeoma Ines Ingrid Isaac Jacques James Jean John Joseph Joy Kemi Kofi Kwame Lars Laura
Lucy Maria Mark Mary Mehmet Michael Mohammed Musa Nadia Ngozi Nkechi Obinna Olga Olumide Patience Paul Peter Pierre Precious Priya Rachel Rajesh Rebecca Rose
Ruth Samuel Sarah Sean Segun Sofia Stephen Sunday Tariq Temitope Thomas Tunde Uche Victoria Wei Yusuf Zainab Zoé Désirée Björn José Inês Ṣadé Ọláìtán Tọ́pẹ́
""".split()
FAMILY = """
Abiola Adebayo Adeyemi Afolabi Akinola Alvarez Andersen Balogun Banerjee Bello Bianchi Brown Chukwu Clarke Cohen Costa Danjuma Davies Diallo Dubois Edwards
Eze Fashola Fernandes Fischer Garba García Green Gupta Hansen Hoang Hughes Ibekwe Idowu Ivanov Jackson Johnson Kamara Kaya Khan Kim Kowalski Lawal Lefèvre Lopez Mbeki
Mensah Mohammed Moreau Müller Mustafa Nguyen Novak Nwosu Obi Odukoya Ogunleye Okafor Okeke Okonkwo Oladipo Osei Patel Popescu Quaye Rossi Sani Sato Schmidt Sharma
Silva Singh Smith Sokolova Suleiman Taylor Traoré Umar Usman Wagner Walker Wang Williams Yakubu Yeboah Zhang Adékúnlé Ògúnbọ̀wálé Søndergård Núñez
""".split()
#: Syllables of invented names, towns and words.
SYLLABLES = "ka be lo min dar sha ro ti un gul per ov ash len tor wi ya nek sul ham ive ing do fra cor pel mo sti zu ber och ela nor gwe tan ri jo fen ulk bra ose ard".split()
STREET_ENDS = "Street Road Avenue Lane Close Crescent Drive Way St Rd Ave St. Rd. Terrace Square Court Place Boulevard Highway Gardens Estate Hill Row Walk View Alley Bypass Layout".split()
STREET_NAMES = "Church;Station;Mill;King;Queen;Park;High;Market;Victoria;School;River;Garden;Hospital;Airport;Independence;Liberty;Old Mill;New Market;Green Park;Palm;Mango;Baobab;Cedar;Rose;Hill Top;Main;Ring;Bank;Coronation;Bishop".split(";")
RUE = "rue;avenue;boulevard;place;impasse;allée;chemin;quai".split(";")
RUE_NAMES = "de la Gare;du Moulin;des Lilas;de la République;Victor Hugo;des Écoles;du Marché;de l'Église;Saint-Jean;du Port;des Jardins;Neuve;de la Paix;du Château;des Fleurs".split(";")
DOMAINS = "com org net edu example test info co.uk com.ng org.ng gov health care io fr de med invalid local".split()
HOST_WORDS = "mail post clinic hospital med chest health care web inbox lab xray imaging radiology doc office home".split()
# Common words of reports, around which unknown words stand in the invented prose.
COMMON = (
    "the a an of in on at to with and or is are was were not no as by for from than more less over under near after before since which that this it both each all some any other same new old left right upper lower "
    "seen noted normal clear small large mild moderate marked slight possible likely no film view chest heart lung lungs zone lobe base apex hilum border shadow opacity nodule mass line tube rib spine clavicle aorta "
    "pleural pericardial mediastinal tracheal cardiac basal apical lateral posterior anterior patient cough fever pain weeks days months years mm cm size shape margin contour side change changes stable compared "
    "suggests suggesting shows showing without within between along about may be has have had can could should well only also still again however although though despite because where while when until if"
).split()
FOREIGN = "le la les de du des un une et à au avec sans sur pour dans par est ó ní kò ń ti sí àti náà wa ko o os as do da em não com na no e por para der die das und mit ein zu di dey dem im wey go don и на в не το και".split()
ACCENTED = {"a": "áàâãạ", "e": "éèêëẹ", "i": "íìî", "o": "óòôọõ", "u": "úùûü"}
MISREAD = "cp1252 latin-1 mac_roman cp437 cp850 cp1251 cp1250".split()
MONTHS = "January February March April May June July August September October November December".split()


#: The plain sentences that hold numbers of things.
NUMBERED = [line for line in PLAIN if "<m>" in line]


def _misread(text: str, r: random.Random) -> str:
    """Text as it looks after one reading in a wrong code page."""
    return text.encode("utf-8").decode(r.choice(MISREAD), "replace")


class Fillers:
    """Values of every kind from one seeded generator."""

    def __init__(self, seed: int, small: tuple[str, ...] = (), capital: tuple[str, ...] = ()):
        self.r, self.small, self.capital = random.Random(seed), small, capital

    def word(self, least: int = 2, most: int = 3) -> str:
        """A word that names nobody: of syllables, or a whole word of the vocabulary."""
        return self.r.choice(self.small) if self.small and self.r.random() < 0.6 else self.made(least, most)

    def made(self, least: int = 2, most: int = 3) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(least, most)))

    def proper(self, least: int = 2, most: int = 3) -> str:
        """A made-up proper name, or a word that the vocabulary holds with a capital only."""
        w = self.made(least, most)
        return self.r.choice(self.capital) if self.capital and self.r.random() < 0.25 else w[0].upper() + w[1:]

    def cap(self, least: int = 2, most: int = 3) -> str:
        w = self.word(least, most)
        return w[0].upper() + w[1:]

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))

    def given(self) -> str:
        return self.r.choice(GIVEN) if self.r.random() < 0.4 else self.proper()

    def family(self) -> str:
        r, k = self.r, self.r.random()
        one = r.choice(FAMILY) if r.random() < 0.4 else self.proper()
        if k < 0.1:
            return f"{one}-{r.choice(FAMILY) if r.random() < 0.5 else self.proper()}"
        if k < 0.14:
            return f"{r.choice(['van', 'de', 'da', 'bin', 'al', 'El', 'Van der', 'dos', 'Mac', 'von'])} {one}"
        if k < 0.17:
            return f"{r.choice(['O', 'D', 'N'])}{r.choice(chr(39) + '’')}{one}"
        if k < 0.25:
            at = r.randrange(len(one))
            return one[:at] + one[at:].replace("a", r.choice("áàâã"), 1).replace("e", r.choice("éèêẹ"), 1).replace("o", r.choice("óôọö"), 1)
        return one

    def name(self) -> str:
        r = self.r
        g, f, k = self.given(), self.family(), r.random()
        middle = r.choice([f"{r.choice('ABCDEFGHIJKLMNOPRSTUVWY')}.", self.given(), r.choice("ABCDEFGHJKLMNOPRST")])
        if k < 0.30:
            full = f"{g} {f}"
        elif k < 0.42:
            full = f"{g} {middle} {f}"
        elif k < 0.55:
            full = r.choice([f"{g[0]}. {f}", f"{g[0]} {f}", f"{g[0]}.{r.choice('ABEJMOT')}. {f}", f"{g[0]}. {r.choice('ABEJMOT')}. {f}", f"{g[0]}.{f}"])
        elif k < 0.71:
            full = f
        elif k < 0.78:
            full = g
        elif k < 0.92:
            full = r.choice([f"{f}, {g}", f"{f.upper()}, {g}", f"{f.upper()} {g}", f"{f}, {g[0]}.", f"{f}, {g} {middle}", f"{g} {f.upper()}", f"{f} {g[0]}."])
        else:
            full = f"{g} {self.given()} {f}"
        k = r.random()
        return full.upper() if k < 0.12 else full.lower() if k < 0.2 else full

    def phone(self) -> str:
        """Digits in groups, with a trunk zero or a country code, in brackets or with separators."""
        r = self.r
        country = r.choice(["+", "00"]) + str(r.choice([r.randint(1, 9), r.randint(20, 99), r.randint(200, 999)]))
        area = "0" + self.digits(r.choice([2, 2, 3, 3, 4]))
        groups = r.choice([[3, 4], [4, 4], [3, 3], [3, 2, 2], [2, 2, 2], [6], [7], [3, 3, 2], [4, 3], [2, 2, 2, 2], [5], [8]])
        tail = [self.digits(n) for n in groups]
        sep = r.choice([" ", "-", ".", " ", "-", ""])
        k = r.random()
        if k < 0.18:
            return f"({area}){r.choice([' ', '', '-'])}{sep.join(tail)}"
        if k < 0.28:
            return f"{area}/{(sep or ' ').join(tail)}" if r.random() < 0.7 else f"{area}/{''.join(tail)}"
        if k < 0.55:
            return sep.join([area, *tail])
        if k < 0.62:
            return f"{country} ({r.choice([area, area.lstrip('0') or '20'])}) {sep.join(tail)}"
        if k < 0.72:
            return country + (area.lstrip("0") or "80") + "".join(tail)
        if k < 0.78:
            return f"({country}) {sep.join([area.lstrip('0') or '80', *tail])}"
        return (sep or " ").join([country, r.choice([area, area.lstrip("0") or "80"]), *tail])

    def email(self) -> str:
        r = self.r
        a, b = r.choice([r.choice(GIVEN), self.proper()]).lower(), r.choice([r.choice(FAMILY), self.proper()]).lower()
        a, b = (re.sub("[^a-z]", "", x) or "info" for x in (a, b))
        local = r.choice([f"{a}.{b}", f"{a}-{b}", f"{a}_{b}", f"{b}_{a[0]}", f"{a[0]}.{b}", f"{a}{b}", f"{a}{self.digits(r.randint(1, 4))}", f"{b}{self.digits(r.randint(1, 3))}", f"{a}+{r.choice(HOST_WORDS)}", f"{a[0]}{b}", b, a, f"dr.{b}", f"{a}.{b}{self.digits(2)}"])
        host = r.choice([self.made(), r.choice(HOST_WORDS), f"{self.made()}-{r.choice(HOST_WORDS)}", f"{r.choice(HOST_WORDS)}.{self.made()}", f"{r.choice(HOST_WORDS)}{self.made(1, 2)}"]) + "." + r.choice(DOMAINS)
        spaced_dot = r.choice([host, host.replace(".", " dot "), host.replace(".", "[dot]"), host.replace(".", "(dot)"), host.replace(".", " . ")])
        k = r.random()
        if k < 0.55:
            out = f"{local}@{host}"
        elif k < 0.68:
            out = r.choice([f"{local} @ {host}", f"{local}@ {host}", f"{local} @{host}"])
        else:
            out = local + r.choice([" (at) ", "(at)", "[at]", " [at] ", " at ", " AT ", "{at}", "<at>"]) + spaced_dot
        return out.upper() if r.random() < 0.1 else out

    def number(self) -> str:
        """A number of a person: letters and digit groups in many orders."""
        r, k = self.r, self.r.random()
        sep = r.choice(["-", "/", " ", "-", "/", "."])
        if k < 0.3:
            return self.digits(r.choice([5, 6, 7, 8, 8, 9, 10, 11, 11, 12, 13]))
        if k < 0.5:
            return self.letters(r.choice([1, 1, 2, 2, 3])) + self.digits(r.randint(5, 10)) + (self.letters(1) if r.random() < 0.3 else "")
        if k < 0.68:
            return sep.join([self.letters(r.choice([1, 2, 2, 3, 4])), *[self.digits(r.randint(2, 6)) for _ in range(r.choice([1, 2, 2, 3]))]]) + (sep + self.letters(1) if r.random() < 0.3 else "")
        if k < 0.9:
            return sep.join(self.digits(r.randint(2, 5)) for _ in range(r.choice([2, 3, 3, 4]))) + (sep + self.letters(r.randint(1, 2)) if r.random() < 0.15 else "")
        return self.digits(r.randint(3, 7)) + sep + self.letters(r.randint(1, 3))

    def street(self) -> str:
        r = self.r
        base = r.choice(STREET_NAMES) if r.random() < 0.4 else r.choice(FAMILY) if r.random() < 0.3 else self.proper() + (f" {self.proper()}" if r.random() < 0.25 else "")
        return f"{base} {r.choice(STREET_ENDS)}"

    def town(self) -> str:
        return self.proper(2, 4) + (f" {self.r.choice(['North', 'South', 'East', 'West', 'GRA', 'Central'])}" if self.r.random() < 0.08 else "")

    def address(self) -> str:
        r, k = self.r, self.r.random()
        no = str(r.randint(1, 400)) + (r.choice("ABCD") if r.random() < 0.15 else "")
        end = r.choice([f", {self.town()}", f", {self.town()}", f" {self.town()}", "", f", {self.town()} {self.digits(5)}", f", off {self.street()}"])
        comma = r.choice([" ", " ", ", "])
        if k < 0.28:
            return f"{no}{comma}{self.street()}{end}"
        if k < 0.42:
            return f"{r.choice(['Flat', 'Apt', 'Apt.', 'Apartment', 'Room', 'Suite', 'Unit', 'Block', 'Flat', 'House'])} {no}{r.choice([', ', ' ', '/'])}{r.randint(1, 300)} {self.street()}{end}"
        if k < 0.54:
            return f"{r.choice(['Plot', 'Plot no.', 'Lot', 'Plot'])} {no}{r.choice([', ', ' ', ', Block ' + r.choice('ABCD') + ', '])}{self.street()}{end}"
        if k < 0.68:
            return f"{r.choice(['No.', 'No', 'no.', 'House No.', 'House no.', 'House', 'Hse', 'No:'])} {no}{comma}{self.street()}{end}"
        if k < 0.84:
            return f"{r.choice(['P.O. Box', 'PO Box', 'P. O. Box', 'P.O.Box', 'Box', 'PMB', 'P.M.B.', 'Postbox', 'POB', 'BP'])} {r.randint(10, 99999)}{r.choice([', ' + self.town(), ' ' + self.town(), ''])}"
        return f"{no}{comma}{r.choice([*RUE, 'Rue'])} {r.choice(RUE_NAMES) if r.random() < 0.6 else r.choice(['des ', 'du ', 'de ', 'de la ', '']) + self.proper()}{r.choice([', ' + self.town(), ' ' + self.town(), ', ' + self.digits(5) + ' ' + self.town(), ''])}"

    def day(self) -> str:
        r = self.r
        d, m, y = r.randint(1, 28), r.randint(1, 12), r.randint(2005, 2029)
        return r.choice([f"{d} {MONTHS[m - 1]}", f"{d} {MONTHS[m - 1]} {y}", f"{d:02d}/{m:02d}/{y}", f"{y}-{m:02d}-{d:02d}", f"{d}.{m}.{y}", f"{MONTHS[m - 1]} {y}", f"{d}/{m}/{y % 100:02d}", f"{MONTHS[m - 1][:3]} {d}, {y}", str(y)])

    def count(self) -> str:
        return str(self.r.randint(1, 99)) if self.r.random() < 0.85 else self.digits(self.r.randint(3, 4))

    def thing_number(self) -> str:
        """A number that identifies nobody, of the same forms as those that do."""
        k = self.r.random()
        return str(self.r.randint(1, 99)) if k < 0.15 else self.digits(self.r.randint(3, 5)) if k < 0.3 else self.number()

    def of(self, kind: str) -> str:
        makers = {"N": self.name, "P": self.phone, "E": self.email, "I": self.number, "A": self.address, "T": self.town, "W": self.cap, "w": self.word, "d": self.day, "n": self.count, "m": self.thing_number}
        value = makers[kind]()
        return _misread(value, self.r) if kind in "NT" and not value.isascii() and self.r.random() < 0.2 else value


def _choose(pattern: str, r: random.Random) -> str:
    """The pattern with every alternative decided, inner ones first."""
    while (out := CHOICE.sub(lambda m: r.choice(m.group(1).split("|")), pattern)) != pattern:
        pattern = out
    return pattern


def _fill(pattern: str, fill: Fillers) -> tuple[str, list[tuple[int, int, str]]]:
    text, spans, at = "", [], 0
    for m in SLOT.finditer(pattern):
        text += pattern[at : m.start()]
        value = fill.of(m.group(1))
        if m.group(1) in KIND:
            spans.append((len(text), len(text) + len(value), KIND[m.group(1)]))
        text += value
        at = m.end()
    return text + pattern[at:], spans


def labelled_table(seed: int = 3, copies: int = 9, small: tuple[str, ...] = (), capital: tuple[str, ...] = ()) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) rows: every pattern with ``copies`` fillings, plain sentences around and between them.

    ``small`` and ``capital``: words of a vocabulary found in small letters, and only with a capital.
    """
    fill = Fillers(seed, small, capital)
    r = fill.r
    rows = []

    def plain(lines: list[str] = PLAIN) -> str:
        """A sentence without personal data; in some of them words give way to unknown ones."""
        out = _fill(_choose(r.choice(lines), r), fill)[0]
        rate = r.choice([0.0, 0.0, 0.2, 0.5])

        def unknown(m: re.Match) -> str:
            if r.random() >= rate:
                return m.group()
            w = fill.word(2, 4)
            return w.upper() if m.group().isupper() else w.capitalize() if m.group()[0].isupper() else w

        out = WORD.sub(unknown, out) if rate else out
        return _misread(out, r) if not out.isascii() and r.random() < 0.3 else out

    def cased(text: str, capital: float, small: float) -> str:
        style = r.random()
        out = text.upper() if style < capital else text.lower() if style < capital + small else text
        return out if len(out) == len(text) else text

    def prose() -> str:
        """An invented sentence: common words, unknown words in any case, numbers and signs, and nobody in it."""
        known, foreign = r.choice([0.3, 0.5, 0.7, 0.85]), r.random() < 0.2
        out = []
        for k in range(r.randint(3, 16)):
            u = r.random()
            w = r.choice(COMMON) if u < known else fill.word(1, 4) if u < known + 0.85 * (1 - known) else r.choice([fill.count(), fill.cap(), fill.cap(), f"{fill.count()} mm", f"({fill.word()})", f"{fill.word()}-{fill.word(1, 2)}", f"“{fill.word()}”", fill.day(), f"{fill.cap()}-{fill.cap()}"])
            if foreign and r.random() < 0.5:
                w = r.choice(FOREIGN) if r.random() < 0.4 else re.sub("[aeiou]", lambda m: r.choice(ACCENTED[m.group()]) if r.random() < 0.4 else m.group(), fill.word(1, 4))
            out.append(w + (r.choice([",", ";", ":", " -", " –", ".", " /"]) if r.random() < 0.08 else ""))
        text = " ".join(out)
        if r.random() < 0.8:
            text = text[:1].upper() + text[1:]
        if r.random() < 0.1:
            text = text.title() if r.random() < 0.5 else text.upper()
        text = _misread(text, r) if foreign and r.random() < 0.2 else text
        return text + r.choice([".", ".", ".", "", ":", " ", "?", ";"])

    def listing() -> str:
        """A heading or connecting word with unknown words after it, in small letters."""
        head = r.choice(["History", "Indication", "Clinical note", "Complaint", "Referred for", "Known", "Past history", "Findings", "Impression", "Note", "Comment", "Ref.", "View", "Reason", "Occupation", "Ward", "Diagnosis", "Technique", "Quality", "Course", "Query", "Background"])
        items = [" ".join([*([r.choice(COMMON)] if r.random() < 0.4 else []), *(fill.word(1, 4) for _ in range(r.randint(1, 3))), *([r.choice(COMMON)] if r.random() < 0.3 else [])]) for _ in range(r.randint(1, 4))]
        return head + r.choice([": ", " - ", ": ", ", ", " / ", " "]) + r.choice([", ", "; ", ", then ", " and ", " / "]).join(items) + r.choice([".", "", "; ", ".", f" since {fill.day()}.", f" for {fill.count()} weeks.", f", {fill.count()} y {r.choice(['man', 'woman', 'M', 'F'])}."])

    def filler() -> str:
        k = r.random()
        return plain() if k < 0.35 else plain(NUMBERED) if k < 0.55 else prose() if k < 0.8 else listing()

    gaps = ["\n", " ", "\n", "\r\n", " ", "\n- ", "; ", " / "]
    for _ in range(copies):
        for pattern in PATTERNS:
            text, spans = _fill(_choose(pattern, r), fill)
            before = filler() + r.choice(gaps) if r.random() < 0.6 else ""
            after = r.choice(gaps) + filler() if r.random() < 0.6 else ""
            rows.append((cased(before + text + after, 0.06, 0.1), [(a + len(before), z + len(before), k) for a, z, k in spans]))
        rows += [(cased(r.choice([" ", "\n"]).join(filler() for _ in range(r.randint(1, 4))), 0.08, 0.1), []) for _ in range(4 * len(PLAIN) // 3)]
    return rows
