"""Sentences written by hand, apart from the grammar that problem 2 is fitted on, and items for them."""

from __future__ import annotations

import random

EMAIL = """Reply to {} soon.|My old address was {} but it bounces.|Forward the minutes to {} before lunch|Our treasurer ({}) keeps the list.|{} is where complaints end up.|Send it over: {}|Please add {} to the thread.|From: {}|Bcc {} on that one|The form says "{}" is invalid.|For refunds, {}|I typed {} twice and still nothing|Whoever runs {} should see this.|Invite {} and me.|* {}|1. {} (primary)|Subscribed as {}, never got a digest.|maintainer = {}|"assignee": "{}",|Sign in with {} instead.|<{}>|I am {} on the forum too.|ping {} if it stalls|Has anyone heard from {}?|you'll find me under {}|The invoice went to {} by mistake!|--author="{}"|Kontakt: {}|Escríbeme a {} mañana|Mon adresse est {}.|We lost everything sent to {}.|Key registered for {}|{} / backup contact|Questions go to {}; thanks.|cc'd {} already|curl -d user={} https://x.invalid|Set REPLY_TO to {} first|Is {} still valid?|My brother uses {} at work.|Old: {}
new: unknown|Write {} a line.|spam keeps coming from {}""".split("|")
PHONE = """Reception is {} on weekdays.|You can get hold of me at {} after six.|Leave a voicemail under {}|Mobile no: {}|{} (landline)|fax machine {}|Try {} if the doorbell is broken.|They gave me {} as the helpline.|Text STOP to {}|Emergency contact {}|"tel": "{}",|phone={}|Nobody picks up at {}!|Ring {} and ask for the porter|my cell: {}|Office {}, home unknown|Telefon {}|Llámame al {}|Joignable au {} le matin|I was called from {} three times today.|Call back number: {}|WhatsApp {}|The caller id showed {}.|dial {} to reach the front desk|* Phone {}|Support hotline: {}.|Please phone {} tomorrow|SMS codes go to {}, always late|Contact by telephone: {}|Give us a ring: {}|Hotel desk {}|Tel.: {}|old mobile {}, new one pending|Our landlord answers {} only|+ phone: {}|callback_phone = "{}"|Her extension is behind {}|The plumber's number is {}|reach the clinic at {}|Just ring {}""".split("|")
ID = """My social security number is {}.|passport: {}|It printed the tax number {} in plain text.|SSN {} leaked in the dump|National ID {} was refused at the counter.|personal id: {}|The clerk copied my passport number {} wrongly.|"ssn": "{}"|passport_no={}|insurance number {} expired|Her identity card {} is on file.|Taxpayer {}|DNI {}|CPF: {}|Steuer-ID {}|ID number: {}|He wrote his passport {} on the form.|the system shows {} as my identity number|Driving licence {} attached|Please check passport {}|citizen number {} not found|social security: {}|National insurance {} is mine|tax id {} in row two|Reisepass {}|My identity number, {}, is printed there.|* SSN: {}|Passport no {} (renewed)|person_id={}|the insurance card says {}|Pasaporte {}|identity document {}|They asked for ssn {} twice!|licence number {}|Tax ID: {}.|passport {} belongs to my aunt|id card: {}|Your national identity {} was exported|social-security {}|Passport #: {}""".split("|")
ADDRESS = """Our new flat is at {}.|The courier left it at {} again.|Billing address: {}|Meet me outside {} at noon.|{} is closed for repairs.|The geocoder returns nothing for {}.|shipping_address={}|I grew up at {}, believe it or not.|Parcel for {}|Send a postcard to {}!|The surgery moved to {}.|Lieferadresse: {}|Vivo en {}|J'habite {}|We rent {} until spring.|"street": "{}",|Return to sender: {}|Invoice to {}|Pick-up point {}|Home: {}|From {} it takes ten minutes.|The plaque at {} is missing.|* {}|drop it at {}, please|Fire brigade called to {}|My grandmother's house, {}, was sold.|Office - {}|Directions to {}?|delivery failed for {}|Venue: {}|Registered at {}.|The keys are at {}|He was last seen near {}|visit us: {}|found on the label: {}|warehouse={}|Rechnung an {}|The van stops at {} first.|Come to {} on Sunday|Location {}""".split("|")
NAME = """Yesterday {} showed me the workaround.|I talked it over with {} at lunch.|Credit goes to {}, honestly.|{} maintains that module.|Ask {} about the backup.|My dentist is {}.|According to {}, it is a known problem.|Kind regards, {}|The patch by {} fixed it.|{} wrote the original parser.|author: {}|Met {} at the conference.|Please welcome {} to the group.|reviewer = "{}"|Thanks to {} for the hint.|Signed, {}|Our neighbour {} has the spare key.|"customer": "{}",|Dear {}, I hope you are well.|It was {} who found the leak.|Mr {} will call back.|Invoice made out to {}|cc: {}|As {} pointed out, the cache is stale.|I am {} and I teach biology.|Best,
{}|Interview with {}|{} said it works for her.|The account belongs to {}.|Best wishes
{}|{}'s laptop has the same fault.|Can somebody reach {}?|He was replaced by {} last week.|Speaker: {}|My sister {} sent the photo.|Photo taken by {}|{} confirmed the outage.|the nurse, {}, was kind|Sincerely, {}|I forwarded everything to {}.|Was {} in the meeting?""".split("|")
SOUND = """The server at 10.20.30.40 refused the connection.|Upgrade from 3.11.4 to 3.12.0 first.|See release notes for Quiet Harbor 2.4.1 please.|clone git@code.invalid:team/app.git and build it|redis://cache:secret@cache.internal:6379/0 works|The daemon noreply@build.internal sends these.|ping me, @nightowl|requests@2.31.0 is pinned|Job 4481920377 finished after 12 minutes.|Order 99120345 shipped on 2024-03-18 10:22:05.|sha 3f9a8c1d2e7b4a60 is bad|Ticket ABC-1042 is closed.|It took 1,204,332 rows and 17 seconds.|Port 5432 is taken on this host.|Open Settings, then Advanced Options.|The Open Data Portal moved.|Line 1200 of the log, column 33|Ubuntu 22.04 and Docker 24.0.7|Each Monday Morning Report is late.|There are 300 Hungry Customers waiting|Chapter 12 Lane Detection is hard.|1699999999 is a timestamp|UUID 123e4567-e89b-12d3-a456-426614174000|Warning: Disk Usage High|Between 100 and 250 requests a second|The value 0.3333333 is rounded.|pip install left-pad@1.3.0|v2.0.17 broke it|rate limit 5000 per hour|Use Control Shift Escape to leave.|coordinates 51.5072, -0.1276|price 1.299,00 in the shop|ISBN 978-3-16-148410-0 is the book|page 44 Road Map is outdated|ERROR: CONNECTION LOST AFTER RETRY|Version 20240318.2 was withdrawn.|the hash is deadbeef1234|2024-12-01T08:15:00Z start|batch 000123456 rerun|Das Fenster bleibt offen.|La Casa Blanca es un proyecto.|Each Worker Thread waits.|1/2/2024 or 02.01.2024|17:45:30 was the last beat|Tuesday Wednesday Thursday|root@localhost had mail|postgres://app:pw@db.local/main|mask 255.255.255.0|build 20231105.7712 passed|Trace 88213345671 ended""".split("|")
FIRST = "Maria Tom Anna Peter Leila Kofi Ruth Jonas Priya Elena Marcus Ingrid Wendy Tobias Aroha Mikko".split()
LAST = "Winterbourne Okonjo Lindgren Castellano Achterberg Moreau Tanaka Fitzroy Delacroix Novak Ashdown Rivers".split()


def item(rnd: random.Random, kind: str) -> str:
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    first, last = rnd.choice(FIRST), rnd.choice(LAST)
    if kind == "email":
        return rnd.choice((f"{first}.{last}@winter-mail.org".lower(), f"{first[0]}{last}@post.net".lower(), f"{last}{d(2)}@uni.example".lower(), f"{first}@{last}.co.uk".lower(), f"{first} [at] post [dot] org".lower(), f"{first}_{last}@mail.host.de".lower()))
    if kind == "phone":
        return rnd.choice((f"+44 20 {d(4)} {d(4)}", f"({d(3)}) 555-{d(4)}", f"+49 30 {d(7)}", f"0{d(4)} {d(6)}", f"+33 6 {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}-555-{d(4)}"))
    if kind == "id_number":
        return rnd.choice((f"{d(3)}-{d(2)}-{d(4)}", f"AB{d(6)}C", f"K{d(8)}", f"{d(8)}-X", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(2)} {d(3)} {d(3)} {d(3)}"))
    if kind == "address":
        return rnd.choice((f"{rnd.randint(1, 300)} Willow Lane, Northcote", f"{rnd.randint(1, 300)} Old Priory Road", f"Gartenstraße {rnd.randint(1, 90)}, {d(5)} Lindau", f"{rnd.randint(1, 90)} rue Victor, {d(5)} Mortagne", f"Calle Olmo {rnd.randint(1, 90)}, {d(5)} Ribera", f"{rnd.randint(1, 300)} Harper Avenue, Apt {rnd.randint(1, 9)}, Milford {d(5)}"))
    return rnd.choice((f"{first} {last}", f"{first} {last}", f"{first} {last}", f"{first} {rnd.choice('ABJKR')}. {last}"))


CARRIERS = {"email": EMAIL, "phone": PHONE, "id_number": ID, "address": ADDRESS, "name": NAME}
