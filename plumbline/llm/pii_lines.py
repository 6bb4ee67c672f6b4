"""The labelled table that the field of pii.py is trained on.  Words, and in brackets an entity: [KIND its words].

All persons, numbers and places are made up; card numbers are the public test numbers of card schemes.
"""

LABELLED = """
please call [PHONE (415) 555-0132] before noon
phone: [PHONE 555-867-5309] or write
tel [PHONE 020 7946 0958] ask for the desk
my number is [PHONE 212-555-0187] thanks
fax [PHONE (303) 555-0119] and mail
the [PHONE (312) 555-0143] line was busy
to [PHONE (202) 555-0171] 3019774 and on
no [PHONE (503) 555-0118] 77123 left
reach us at [PHONE 800.555.0147] today
Telefon [PHONE 030 901820] im Haus
mobile [PHONE 07700 900123] at night
call [PHONE 555-0199] now
she left [PHONE (212) 555-0144] with the clerk
numéro [PHONE 01 99 00 12 34] le matin
teléfono [PHONE 91 123 45 67] por la tarde
[PHONE (646) 555-0170] is the office
Phone [PHONE 617-555-0126], room 4
Call [PHONE (718) 555-0162] or come by
ring me on [PHONE 0161 496 0345] after six
Tel.: [PHONE 089 636-48018] (Zentrale)
text [PHONE 404 555 0178] when there
write to [EMAIL jane.doe(at)example.com] please
mail [EMAIL jane_doe[at]example.org] for help
email [EMAIL john@localhost] or wait
contact [EMAIL info(at)example.net] and ask
e-mail: [EMAIL bob.smith@intranet] at work
[EMAIL mary(at)example.com] replied
send it to [EMAIL joe [at] mail [dot] com] soon
reach me: [EMAIL ann.lee [at] example [dot] org]
mail [EMAIL tom at example dot com] for more
address [EMAIL sue.r (at) example (dot) net] works
the [EMAIL max(at)example.de] box is full
the server [IP 2001:db8::1] answered
host [IP fe80::1ff:fe23:4567:890a] went down
address [IP 2001:0db8:85a3:0000:0000:8a2e:0370:7334] was logged
from [IP ::1] to there
login from [IP 2001:db8:0:1::5] failed
ip: [IP 2001:db8:cafe::17] blocked
card [CARD 4111.1111.1111.1111] was charged
visa [CARD 4012.8888.8888.1881] expired
pay with [CARD 5500/0000/0000/0004] in the shop
my card [CARD 3400_000000_00009] is lost
Card number: [CARD 5555.5555.5555.4444] on file
ssn [ID 078-05-1120] on file
social security number [ID 219-09-9999] was shown
her [ID 457-55-5462] and the rest
ssn: [ID 123-45-6789] copied
passport [ID X4RTBPFW4] was stolen
Passport No. [ID C01X00T47] expires in May
his passport number is [ID 533380006] as stated
iban [ID DE89370400440532013000] for the rent
IBAN: [ID GB29 NWBK 6016 1331 9268 19] please
pay to [ID FR76 3000 6000 0112 3456 7890 189] today
licence [ID D1234562] was taken
driver license number [ID S530-4607-8890] found
national id [ID 850101-1234] was typed
tax id [ID 12-3456789] and vat
account [ID ES9121000418450200051332] is closed
my name is [NAME Jane Miller] and you
My name is [NAME Carlos Ortega].
name: [NAME Peter Novak], age 41
Name: [NAME Maria Lopez]
signed by [NAME Robert King] yesterday
Signed, [NAME Anna Weber]
contact [NAME John Carter] at the desk
Contact [NAME Lisa Brown] for help
Dear [NAME Emily Clark], we write to you
Dear Mr. [NAME Thompson], thank you
Dear Ms [NAME Olga Petrova],
Mr. [NAME Henry Adams] called twice
the letter of Mrs. [NAME Susan Hall] came
Dr. [NAME Alan Reed] will see you
we met Dr [NAME Laura Schmidt] in the hall
Prof. [NAME Hans Keller] gave a talk
Herr [NAME Klaus Fischer] ist da
Frau [NAME Ingrid Bauer] kommt morgen
Sehr geehrte Frau [NAME Petra Vogel], vielen Dank
Monsieur [NAME Pierre Laurent] est parti
Madame [NAME Claire Moreau] arrive
le docteur [NAME Luc Bernard] est ici
Señor [NAME Juan Herrera] llama mañana
la señora [NAME Carmen Ruiz] vive aquí
regards, [NAME David Stone]
Best regards, [NAME Karen White]
Kind regards [NAME Tom Baker]
thanks, [NAME Julia Roth]
patient [NAME George Hill] was seen
Patient: [NAME Nora Quinn], born 1970
employee [NAME Frank Moss] left
customer [NAME Alice Young] asked again
the customer [NAME Paul Grant] complained
author: [NAME Ruth Lang]
written by [NAME Mark O'Brien] in spring
photo by [NAME Jean-Luc Petit] and others
I spoke with [NAME Diana Cruz] today
we hired [NAME Oscar Lind] last week
ask [NAME Helen Ward] about it
call [NAME Victor Hale] on [PHONE 415-555-0181] now
her friend [NAME Nina Simms] said so
his wife [NAME Elena Rossi] and son
my brother [NAME Sam Porter] lives there
from [NAME Ivan Kovac] to you
to [NAME Grace Liu] with thanks
user [NAME Martin Frost] logged in
invoice for [NAME Sarah J. Bell] sent
by [NAME J. R. Hudson] and team
Mr [NAME William H. Davis] signed
meeting with [NAME Ahmed Khan] at ten
ich heiße [NAME Stefan Krause] und komme
je m'appelle [NAME Sophie Dubois] et vous
me llamo [NAME Pablo Torres] y tú
Ms. [NAME McAllister] agreed
lives at [ADDRESS 12 Elm Street] since May
address: [ADDRESS 45 Oak Avenue, Springfield, IL 62704]
Address: [ADDRESS 9 Mill Lane]
ship to [ADDRESS 221 Baker Road, Leeds LS1 4AB] today
send to [ADDRESS 7 High Street, Oxford] please
moved to [ADDRESS 1600 Pine Drive] last year
home is [ADDRESS 88 Lake View Court, Austin, TX 73301] now
the house at [ADDRESS 310 West Maple Boulevard] burned
at [ADDRESS 5 King's Square] you turn
deliver to [ADDRESS 17 Park Place, Apt 3] by noon
write to [ADDRESS P.O. Box 1234, Denver, CO 80201] only
mail to [ADDRESS PO Box 77, Reno] now
wohnt in der [ADDRESS Hauptstraße 15, 10115 Berlin] seit
Adresse: [ADDRESS Lindenweg 3, 80331 München]
Anschrift [ADDRESS Gartenstr. 22] im Ort
wohnhaft [ADDRESS Bahnhofplatz 1, 50667 Köln] dort
habite [ADDRESS 14 rue de la Paix, 75002 Paris] depuis
adresse : [ADDRESS 3 avenue Victor Hugo, 69003 Lyon]
au [ADDRESS 27 boulevard Voltaire] en haut
vive en [ADDRESS Calle Mayor 8, 28013 Madrid] ahora
dirección: [ADDRESS Avenida del Sol 21, Sevilla]
en la [ADDRESS calle Luna 4] de noche
[NAME Rita Gomez], [ADDRESS 63 Cedar Road], called
[NAME Leo Marsh] lives at [ADDRESS 4 Ash Close, York]
office: [ADDRESS 500 Fifth Avenue, New York, NY 10110]
version 3.0 of the licence
under Version 2.0, January 2004
release 10.4.1 fixed 17 bugs
see section 4.2.1 and table 12
on 2024-01-05 at 12:30 we met
from 1998-09-02 to 1999-12-31 the plan held
the year 2021 had 365 days
about 1,234,567 people in 50 states
price 19.99 or 1.250,00 in total
order 4830021 shipped with 3 items
room 101 on floor 3
page 12-15 and 203-210 of book 7
isbn 978-3-16-148410-0 in print
the score was 3-2 after 90 minutes
a 7305518846291173 counter value
id 99812 and id 77123 were merged
sha 5d41402abc4b2a76b9719d911017c592e1f0a9c3 in git
key "b6d767d2f8ed5d21a44b0e5886680cb90a1b2c3d" in file
commit 7f3a9c1 broke build 5521
mp3 and h264 and utf8 are formats
ratio 1:2 and time 10:45:12 in log
the 1st, 2nd and 3rd of 12 runs
90% of users and 5kg of rice
copyright 2004 2007 2019 all rights
call 3 friends and phone 2 more
card 7 of 52 was red
email 12 people and mail 40 more
@ home and @work today
follow @jane and @john_doe there
a+b=c and x1 y2 z3 are names
int32 x = 5; y = 0x7fff
src12 and src7 in lang 4
tel aviv and mobile homes
number 5 is alive
0.25 0.5 0.75 1.0 are steps
1 2 3 4 5 6 7 8 9 10 counts
100 200 300 400 in rows
11.02.2019 and 3.4.2020 were days
covid-19 and b2b and 4x4
http://example.com/a1/b2 is a page
this is a plain line of words
and another one without any
we went at noon dot and left
look at that dot com bubble
The Apache License is long. The rest is short.
GNU General Public License Version 2, June 1991
Licensed under the Apache License, Version 2.0
On Monday, January 5, we left. Then Tuesday came.
In March we went to New York and Boston.
The United Nations met in Geneva on Friday.
This is a line. And this is one more. So it goes.
Redistribution and use in source and binary forms
THE SOFTWARE IS PROVIDED AS IS WITHOUT WARRANTY
Permission is hereby granted. The above notice shall stay.
Copyright Holder and Contributors keep all rights
University of California and Stanford University
Google Chrome and Microsoft Windows were open
the Great Wall and the Red Sea are far
Chapter One. The Long Road begins here.
World War Two ended in May 1945
Das Haus ist alt. Die Tür ist neu. Der Garten blüht.
Im Januar kam Schnee. Am Montag war Sturm in Berlin.
Il est tard. La nuit tombe. Les rues sont vides.
El sol sale. La casa es grande. Los niños juegan.
Word Word and And And are doubled
Oh Oh said the bird. Bla Bla Bla.
Lorem Ipsum. Ipsum lorem. Dolor sit.
We saw it. They did not. Both were right.
However, Some said no. Most said yes.
Street lights and road signs are old
The road is long and the street is wide
12 streets and 4 roads lead there
in 3 places at 5 points on 7 roads
Section 12 Table 4 Figure 3 and Page 9
Win 2 and Run 3 and Gate 14
Paris is big. London is bigger. Tokyo is the biggest.
Der Mann und die Frau gehen. Wer kommt mit?
Que faire ? Rien. Tout va bien.
By the way, Nothing happened. To be sure, It did.
From here on, All is new. Dear me.
name of the file and address of the page
the author and the customer agreed
best regards to all of you
mr and mrs were out
doctor and patient talked
Contact the office. Call the desk. Ask the clerk.
Name the file. Address the issue. Sign the form.
Contact Sales and ask Support for Help
Dear Customer, your order is here
Dear Sir or Madam, we thank you
passport control and license fees
account 12 and account 15 are open
Belowen. Tarrish of the mill
Toren. Mika, ala ren
Garol. Neres and so
Silo. Vento. Karam the old
Yes. Perhaps. Tomorrow the rest.
Mileno. Orso la vira
Ende. Anfang war gut
Oro. Plata es menos
Fin. Suite demain
Rain. Snow. Wind and more
the end. Later on
of that. Mirolen, and
Kelm | Rasto | Tive
Boro. | Selin | Maran.
Tarin Tarin Tarin
Selden moro ti lan. Gorin of the
Tables. Chairs and Lamps
Morning. Evening. Night.
""".strip().split("\n")
